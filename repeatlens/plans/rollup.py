"""Stored daily rollups: report pages that merge days instead of reading the facts again.

Dispenses are counted by day, store, drug, brand and schedule and written in one folder for
each month (or day). Sums and counts of days add up, so a panel over any range merges the
cells of that range. A day that changes is counted again from the facts of its folder alone
and replaces that folder; the others stay untouched.

Report windows begin at the clock's time of day, not at midnight. A rollup is made for one
such time, its ``edge``, at which every day is cut in two; a report whose clock shows another
time is refused rather than answered roughly.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import Clock, moment, to_clock
from ..functions.values import amount
from ..operators import volumes
from ..sources.tables import Tables
from . import reports

MONTH, DAY = "yyyy-MM", "yyyy-MM-dd"

_CELL = ["day", "late", "StoreId", "Drugname", "BrandName", "DrugSchedule"]


class VolumeRollup:
    """The rollup below ``path``, cut at the time of ``edge``, in folders of ``unit``."""

    def __init__(self, spark: SparkSession, path: str, edge: Clock, unit: str = MONTH):
        if unit not in (MONTH, DAY):
            raise ValueError(f"unit is {MONTH!r} or {DAY!r}, not {unit!r}")
        self.spark, self.path, self.unit = spark, path, unit
        self.edge: time = to_clock(edge).time()

    def _counted(self, dispense: DataFrame) -> DataFrame:
        """Cells of the dispenses. Rows without a date are cells without a day."""
        at = F.col("DispensedDate")
        day = F.to_date(at)
        edge = timedelta(hours=self.edge.hour, minutes=self.edge.minute,
                         seconds=self.edge.second, microseconds=self.edge.microsecond)
        late = at >= day.cast("timestamp_ntz") + F.lit(edge)
        return (
            dispense.withColumns({"day": day, "late": F.coalesce(late, F.lit(False))})
            .groupBy(*_CELL)
            .agg(
                F.count("*").alias("_rows"),
                F.sum(amount(dispense, "DrugVal")).alias("_value"),
                F.sum(amount(dispense, "PatientPrice")).alias("_price"),
                F.count("PatientPrice").alias("_prices"),
            )
        )

    def _write(self, cells: DataFrame, mode: str) -> None:
        # The letter keeps the name a text when folders are read.
        folder = F.concat(F.lit("m"), F.date_format("day", self.unit))
        # A folder is one file, or several where a third of all rows lies in it: cells of a
        # folder follow the catalogue, and are spread over its stores' hashes.
        spread = F.pmod(F.xxhash64("StoreId"), F.lit(8))
        (
            cells.withColumn("folder", folder)
            .repartition("folder", spread)
            .sortWithinPartitions("folder", "day", "StoreId")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", mode)
            .partitionBy("folder")
            .parquet(self.path)
        )

    def build(self, dispense: DataFrame) -> VolumeRollup:
        """Counts all dispenses, replacing what is stored."""
        self._write(self._counted(dispense), "static")
        return self

    def replace(self, dispense: DataFrame, days: Iterable[date]) -> VolumeRollup:
        """Counts the folders of these days again. Their dispenses are read by date ranges;
        a folder of which no dispense is left becomes empty. Repeating it changes nothing."""
        spans = sorted({self._span(day) for day in days})
        if not spans:
            return self
        at = F.col("DispensedDate")
        inside = reduce(
            lambda a, b: a | b, ((at >= moment(start)) & (at < moment(end)) for start, end in spans)
        )
        cells = self._counted(dispense.where(inside))
        # An empty cell for each folder: dynamic overwriting leaves folders without rows alone.
        marks = self.spark.createDataFrame([(start.date(),) for start, _ in spans], "day date")
        marks = marks.withColumns({"late": F.lit(False), "_rows": F.lit(0).cast("long")})
        self._write(cells.unionByName(marks, allowMissingColumns=True), "dynamic")
        return self

    def _span(self, day: date) -> tuple[datetime, datetime]:
        start = datetime(day.year, day.month, 1 if self.unit == MONTH else day.day)
        if self.unit == DAY:
            return start, start + timedelta(days=1)
        return start, datetime(start.year + start.month // 12, start.month % 12 + 1, 1)

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where("_rows > 0")

    def _since(self, as_of: Clock, days: int | None) -> Column:
        if days is None:
            return F.lit(True)
        first = to_clock(as_of) - timedelta(days=days)
        day = F.col("day")
        return F.coalesce((day > F.lit(first.date())) | ((day == F.lit(first.date())) & F.col("late")), F.lit(False))

    def _folders(self, as_of: Clock, days: int) -> Column:
        """Prunes folders that end before the range."""
        first = (to_clock(as_of) - timedelta(days=days)).date()
        return F.col("folder") >= F.lit(first.strftime("m%Y-%m" if self.unit == MONTH else "m%Y-%m-%d"))

    def report(
        self, t: Tables, as_of: Clock, days: int | None = None, store_id=None, schedule: str | None = None
    ) -> reports.Report:
        """The volume page, as ``reports.analytics_report`` has it, from the stored cells.

        Only patients and stores are read beside them.
        """
        if to_clock(as_of).time() != self.edge:
            raise ValueError(f"this rollup is cut at {self.edge}, the clock shows {to_clock(as_of).time()}")
        stored = self.cells()
        trend = self._since(as_of, volumes.TREND_DAYS)
        picked = stored if schedule is None else stored.where(F.col("DrugSchedule") == schedule)

        def panels(cells: DataFrame) -> dict[str, DataFrame]:
            marked = cells.withColumns(
                {"_selected": self._since(as_of, days), "_day": F.when(trend, F.col("day"))}
            )
            return reports.volume_panels(marked, stored, t, store_id)

        out = panels(picked)
        if days is not None:
            near = panels(picked.where(self._folders(as_of, days)))
            out |= {k: near[k] for k in ("summary", "top_drugs", "schedule_mix", "store_ranking")}
        out["daily_trend"] = panels(picked.where(self._folders(as_of, volumes.TREND_DAYS)))["daily_trend"]
        return reports.Report(out)
