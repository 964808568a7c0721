"""Page access to an ordered result."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed value: rows on one page.
PAGE_SIZE = 20


def page_rows(
    df: DataFrame, order_by: list[str | Column], page: int = 1, size: int = PAGE_SIZE
) -> DataFrame:
    """Rows of one page, counted from 1. The order must leave no ties.

    Each task keeps only the rows up to the end of the page, so the cost of the
    cut grows with the page number and not with the table.
    """
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order_by).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Rows and pages of a result; an empty result still has one page."""
    pages = F.greatest(F.ceil(F.count("*") / size), F.lit(1))
    return df.agg(F.count("*").alias("total_rows"), pages.cast("long").alias("total_pages"))


class PageIndex:
    """An ordered result, stored in slices, of which a page reads only its own.

    The rows are sorted into ranges, one folder for each slice, with their place in the whole.
    A small table has the size and the last row of every slice: the sum of the sizes before
    tells in which slices a page lies, however far back it is, and the last rows tell where
    the rows behind a given one begin. ``order_by`` names the columns, descending ones with
    a minus in front; nulls come first, or last where descending. They must leave no ties.
    """

    def __init__(self, spark: SparkSession, path: str, order_by: list[str]):
        self.spark, self.path = spark, path
        self.order = [(name.removeprefix("-"), name.startswith("-")) for name in order_by]

    def build(self, df: DataFrame) -> PageIndex:
        """Stores the rows of ``df``, replacing what is stored."""
        order = [F.desc_nulls_last(n) if down else F.asc_nulls_first(n) for n, down in self.order]
        ranged = df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id())
        # The low bits number the rows of a partition, which are sorted.
        row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        rows = ranged.sortWithinPartitions("_slice", *order).withColumn("_row", row)
        rows.write.mode("overwrite").partitionBy("_slice").parquet(f"{self.path}/rows")
        schema = self.spark.createDataFrame([(rows.schema.json(),)], "schema string")
        schema.write.mode("overwrite").parquet(f"{self.path}/schema")  # of an empty result too
        last = F.max_by(F.struct(*(n for n, _ in self.order)), "_row").alias("_last")
        sizes = self._stored().groupBy("_slice").agg(F.count("*").alias("_size"), last)
        before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
        first = F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first")
        sizes.select("_slice", "_size", first, "_last").write.mode("overwrite").parquet(f"{self.path}/slices")
        return self

    def _slices(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/slices")

    def _stored(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").first()[0]
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.path}/rows")

    def _rows(self, first: int, last: int) -> DataFrame:
        """The rows of these slices."""
        return self._stored().where(F.col("_slice").between(first, last))

    def page(self, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
        """Rows of one page, counted from 1, in order."""
        if page < 1 or size < 1:
            raise ValueError("page and size start at 1")
        start, end = (page - 1) * size, page * size
        slices = self._slices().where((F.col("_first") < end) & (F.col("_first") + F.col("_size") > start))
        mine = slices.orderBy("_slice").select("_slice", "_first").collect()  # those of one page
        if not mine:
            return self._shown(self._rows(0, -1))
        rows = self._rows(mine[0]["_slice"], mine[-1]["_slice"])
        firsts = F.create_map(*(F.lit(x) for s in mine for x in (s["_slice"], s["_first"])))
        place = F.col("_row") + F.element_at(firsts, F.col("_slice"))
        return self._shown(rows.where((place >= start) & (place < end)))

    def after(self, key: Mapping[str, object] | None, size: int = PAGE_SIZE) -> DataFrame:
        """The next ``size`` rows behind the one with these values, from the start without any."""
        if key is None:
            return self.page(1, size)
        behind = self._slices().where(self._beyond(key, lambda name: F.col(f"_last.{name}")))
        # The first of these slices may end right behind the key: as many rows in the others.
        first = behind.agg(F.min("_slice")).first()[0]
        if first is None:
            return self._shown(self._rows(0, -1))
        further = self._slices().where(F.col("_slice") > first).orderBy("_slice").select("_slice", "_size")
        last, rows = first, 0
        for row in further.limit(size).collect():  # every slice has a row at least
            if rows >= size:
                break
            last, rows = row["_slice"], rows + row["_size"]
        found = self._rows(first, last).where(self._beyond(key, F.col))
        return self._shown(found.orderBy("_slice", "_row").limit(size))

    def _beyond(self, key: Mapping[str, object], column: Callable[[str], Column]) -> Column:
        """Whether a row comes after ``key``: it differs first in a column where it is beyond."""
        out, same = F.lit(False), F.lit(True)
        for name, down in self.order:
            value, own = key[name], column(name)
            if value is None:
                beyond = F.lit(False) if down else own.isNotNull()
            else:
                beyond = (own < F.lit(value)) | own.isNull() if down else own > F.lit(value)
            out = out | (same & F.coalesce(beyond, F.lit(False)))
            same = same & own.eqNullSafe(F.lit(value))
        return out

    def _shown(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy("_slice", "_row").drop("_slice", "_row")
