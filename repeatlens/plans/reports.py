"""Report bundles: all panels of a page, sharing what they have in common.

Several panels read the same rows at different grain. Instead of one scan per
panel, a bundle groups the fact table once to the finest grain its panels need. By
default nothing is kept (``keep="lazy"``): right when one or two panels are wanted, and
safe at any size. ``keep="table"`` writes that grain as a table to the folder all executors
share; it stays until that folder is cleared. ``keep="persist"`` holds it in the executors'
storage, which suits the volume and refill bundles, whose shared part follows the catalogue
rather than the data; a lost executor means recomputing its part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import Clock, since
from ..functions.values import amount, or_zero
from ..operators import adherence, profile, refills, stores, volumes
from ..operators.filters import dispense_filter, for_store, present
from ..operators.ranking import top_rows
from ..sources.export import save_table, shared_folder
from ..sources.tables import Tables


KEEP_PERSISTED = "persist"
KEEP_TABLE = "table"
KEEP_NOTHING = "lazy"


def _kept(df: DataFrame, keep: str) -> DataFrame:
    if keep == KEEP_TABLE:
        return save_table(df, shared_folder(df.sparkSession, "report"))
    if keep == KEEP_PERSISTED:
        return df.persist()
    if keep == KEEP_NOTHING:
        return df
    raise ValueError(
        f"keep is {KEEP_PERSISTED!r}, {KEEP_TABLE!r} or {KEEP_NOTHING!r}, not {keep!r}"
    )


class Report:
    """Panels by name. Closing it frees the shared intermediate."""

    def __init__(self, panels: dict[str, DataFrame], shared: DataFrame | None = None):
        self.panels = panels
        self._shared = shared

    def __getitem__(self, name: str) -> DataFrame:
        return self.panels[name]

    def __enter__(self) -> Report:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        if self._shared is not None:
            self._shared.unpersist()  # does nothing to a table
            self._shared = None


def volume_cells(dispense: DataFrame, as_of: Clock, days: int | None, schedule) -> DataFrame:
    """Dispenses counted per store, drug, brand and schedule, whether they fall in
    the selected range, and their day inside the trend window.

    The number of cells follows the catalogue and the trend window, not the
    number of dispenses.
    """
    date = F.col("DispensedDate")
    selected = F.lit(True) if days is None else F.coalesce(since(date, as_of, days), F.lit(False))
    trend_day = F.when(since(date, as_of, volumes.TREND_DAYS), F.to_date(date))
    return (
        dispense_filter(dispense, as_of, schedule=schedule)
        .groupBy(
            "StoreId",
            "Drugname",
            "BrandName",
            "DrugSchedule",
            selected.alias("_selected"),
            trend_day.alias("_day"),
        )
        .agg(
            F.count("*").alias("_rows"),
            F.sum(amount(dispense, "DrugVal")).alias("_value"),
            F.sum(amount(dispense, "PatientPrice")).alias("_price"),
            F.count("PatientPrice").alias("_prices"),
        )
    )


def analytics_report(
    t: Tables,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    schedule: str | None = None,
    keep: str = KEEP_NOTHING,
) -> Report:
    """The nine panels of the volume page. Range, store and schedule filters reach
    the panels they apply to: the trend has its own range, the store ranking shows
    all stores, patients and options are never filtered."""
    cells = _kept(volume_cells(t.dispense, as_of, days, schedule), keep)
    options = t.dispense if schedule else cells
    return Report(volume_panels(cells, options, t, store_id), cells)


def volume_panels(cells: DataFrame, options: DataFrame, t: Tables, store_id=None) -> dict[str, DataFrame]:
    """The panels of the volume page from counted ``cells``; ``options`` has the stores and
    schedules to choose from."""
    mine = for_store(cells, store_id)
    picked = mine.where("_selected")
    count = F.sum("_rows")
    value = F.sum("_value").cast("double")
    drugs = (
        present(picked, "Drugname")
        .groupBy(F.col("Drugname").alias("drugName"), F.col("BrandName").alias("brandName"))
        .agg(
            count.alias("totalDispensed"),
            or_zero(value).alias("totalValue"),
            or_zero(
                F.sum("_price").cast("double") / F.nullif(F.sum("_prices"), F.lit(0))
            ).alias("avgPrice"),
        )
    )
    drug_order = [F.desc("totalDispensed"), F.asc("drugName"), F.asc_nulls_first("brandName")]
    return {
        "summary": picked.agg(
            or_zero(count).alias("totalDispenses"),
            or_zero(value).alias("totalValue"),
            F.countDistinct("StoreId").alias("totalStores"),
        ),
        "patients": volumes.patient_total(t.patients),
        "daily_trend": present(mine, "_day")
        .groupBy(F.col("_day").alias("date"))
        .agg(count.alias("count"))
        .orderBy(F.desc("date")),
        "top_drugs": volumes.ranked(drugs, 10, drug_order, []),
        "schedule_mix": picked.groupBy("DrugSchedule")
        .agg(count.alias("count"))
        .select(F.coalesce("DrugSchedule", F.lit("Unclassified")).alias("category"), "count")
        .orderBy(F.desc("count"), "category"),
        "store_ranking": top_rows(
            present(cells.where("_selected"), "StoreId")
            .groupBy(F.col("StoreId").alias("storeId"))
            .agg(count.alias("count"), value.alias("totalValue")),
            10,
            [F.desc("count"), F.asc("storeId")],
        ),
        "gender_mix": volumes.gender_mix(t.patients),
        "stores": stores.store_filter_options(options, t.stores),
        "schedules": volumes.schedule_options(options),
    }


def adherence_report(
    t: Tables,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    keep: str = KEEP_NOTHING,
) -> Report:
    """The panels of the adherence page. Four of them come from one table of
    scripts; the repeat buckets and the store row read the dispenses."""
    rows = present(
        dispense_filter(t.dispense, as_of, days, store_id, drug=drug, min_repeats=min_repeats),
        "PatPharmSysID",
    )
    fills = _kept(adherence.script_fills(rows), keep)
    scripts = present(fills, "OriginalScriptNumber")
    across_stores = scripts.groupBy(
        "PatPharmSysID", "OriginalScriptNumber", "Drugname", "TotalRepeats"
    ).agg(F.sum("DispensedRepeats").alias("DispensedRepeats"))
    panels = {
        "summary": adherence.summarise_scripts(scripts),
        "medication_compliance": adherence.rank_medications(across_stores),
        "compliance_by_repeat": adherence.compliance_by_repeat(
            t.dispense, as_of, days, store_id, drug, min_repeats
        ),
        "medication_gaps": adherence.rank_gaps(scripts),
        "chronic_medications": adherence.rank_chronic(fills),
        "store_activity": stores.store_activity(t.stores, t.dispense, store_id),
    }
    return Report(panels, fills)


def refill_report(
    t: Tables, as_of: Clock, days: int = 3, store_id=None, keep: str = KEEP_NOTHING
) -> Report:
    """List, counts and store row of the refill page. List and counts share the due
    refills; the list leaves out those without a drug name."""
    due = _kept(
        refills.due_refills(t.dispense, t.contacts, as_of, days, store_id, require_drug=False),
        keep,
    )
    panels = {
        "predictions": refills.list_due(present(due, "Drugname"), as_of),
        "summary": refills.summarise_due(due, as_of, days),
        "store": stores.store_contacts(t.stores, t.contacts, store_id),
    }
    return Report(panels, due)


def table_profile(df: DataFrame, date_column: str, key_column: str) -> Report:
    """Columns, size, sample, date coverage and largest keys of one table."""
    return Report(
        {
            "columns": profile.column_profile(df),
            "rows": profile.table_row_counts({"table": df}),
            "sample": profile.sample_rows(df, 3),
            "coverage": profile.date_coverage(df, date_column),
            "keys": profile.rows_per_key(df, key_column),
        }
    )


def profile_lines(df: DataFrame, date_column: str, key_column: str) -> DataFrame:
    """Size, coverage and largest keys of a table as one list of labelled texts."""
    coverage = profile.date_coverage(df, date_column)
    keys = profile.rows_per_key(df, key_column)
    place = F.row_number().over(Window.orderBy(F.desc("TotalDispenses"), key_column))
    size = profile.table_row_counts({"rows": df})
    lines = [size.select(F.lit("size"), "table_name", F.col("total_rows").cast("string"))]
    cells = [F.struct(F.lit(n), F.col(n).cast("string")) for n in coverage.columns]
    lines.append(
        coverage.select(F.inline(F.array(*cells)).alias("name", "value")).select(
            F.lit("coverage"), "name", "value"
        )
    )
    label = F.concat(place.cast("string"), F.lit(": "), F.col(key_column).cast("string"))
    lines.append(keys.select(F.lit("keys"), label, F.col("TotalDispenses").cast("string")))
    result = lines[0]
    for line in lines[1:]:
        result = result.union(line)
    return result.toDF("section", "name", "value")
