"""Dispensing volumes: totals, trends, mixes and rankings.

Without a store the panels describe the whole chain; ``by_store=True`` gives one
result per store instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import Clock, time_text
from ..functions.values import mean_amount, or_zero, total_amount
from .filters import dispense_filter, present, same_day
from .ranking import newest_first, top_rows

# Fixed value: the trend always shows this many days, whatever range is selected.
TREND_DAYS = 30


def per_store(by_store: bool) -> list[str]:
    return ["StoreId"] if by_store else []


def dispense_summary(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    schedule: str | None = None,
    by_store: bool = False,
) -> DataFrame:
    """Dispenses, their value and the number of stores; zero when there are none."""
    rows = dispense_filter(dispense, as_of, days, store_id, schedule)
    return rows.groupBy(*per_store(by_store)).agg(
        F.count("*").alias("totalDispenses"),
        or_zero(total_amount(rows, "DrugVal")).alias("totalValue"),
        F.countDistinct("StoreId").alias("totalStores"),
    )


def patient_total(patients: DataFrame) -> DataFrame:
    """Distinct patients; no report filter applies."""
    return patients.agg(F.countDistinct("dispenseid").alias("totalPatients"))


def daily_trend(
    dispense: DataFrame,
    as_of: Clock,
    store_id=None,
    schedule: str | None = None,
    by_store: bool = False,
) -> DataFrame:
    """Dispenses per calendar day over the trend window, newest first."""
    keys = per_store(by_store)
    rows = dispense_filter(dispense, as_of, TREND_DAYS, store_id, schedule)
    return (
        rows.groupBy(*keys, F.to_date("DispensedDate").alias("date"))
        .agg(F.count("*").alias("count"))
        .orderBy(*keys, F.desc("date"))
    )


def _most(column: str, *ties: str) -> list[Column]:
    return [F.desc(column), *(F.col(name).asc_nulls_first() for name in ties)]


def top_drugs(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    schedule: str | None = None,
    n: int = 10,
    by_store: bool = False,
) -> DataFrame:
    """The most dispensed drugs with value, average price and display rank."""
    keys = per_store(by_store)
    rows = present(dispense_filter(dispense, as_of, days, store_id, schedule), "Drugname")
    totals = rows.groupBy(
        *keys, F.col("Drugname").alias("drugName"), F.col("BrandName").alias("brandName")
    ).agg(
        F.count("*").alias("totalDispensed"),
        or_zero(total_amount(rows, "DrugVal")).alias("totalValue"),
        or_zero(mean_amount(rows, "PatientPrice")).alias("avgPrice"),
    )
    return ranked(totals, n, _most("totalDispensed", "drugName", "brandName"), keys)


def ranked(totals: DataFrame, n: int, order: list[Column], keys: list[str]) -> DataFrame:
    """The first ``n`` rows with a 1-based rank, per store when ``keys`` is given.
    The rank of the whole is numbered after the cut, over ``n`` rows."""
    top = totals if keys else totals.orderBy(*order).limit(n)
    window = Window.partitionBy(*keys).orderBy(*order)
    placed = top.withColumn("rank", F.row_number().over(window))
    return placed.where(F.col("rank") <= n).orderBy(*keys, "rank")


def schedule_mix(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    schedule: str | None = None,
    by_store: bool = False,
) -> DataFrame:
    """Dispenses per drug schedule. A missing schedule is labelled; an empty one
    stays a group of its own."""
    keys = per_store(by_store)
    return (
        dispense_filter(dispense, as_of, days, store_id, schedule)
        .groupBy(*keys, "DrugSchedule")
        .agg(F.count("*").alias("count"))
        .select(
            *keys, F.coalesce("DrugSchedule", F.lit("Unclassified")).alias("category"), "count"
        )
        .orderBy(*keys, F.desc("count"), "category")
    )


def store_ranking(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    schedule: str | None = None,
    n: int = 10,
) -> DataFrame:
    """The stores with most dispenses. The store filter never applies here."""
    rows = present(dispense_filter(dispense, as_of, days, schedule=schedule), "StoreId")
    totals = rows.groupBy(F.col("StoreId").alias("storeId")).agg(
        F.count("*").alias("count"),
        total_amount(rows, "DrugVal").alias("totalValue"),
    )
    return top_rows(totals, n, _most("count", "storeId"))


def gender_mix(patients: DataFrame) -> DataFrame:
    """Patients per gender, read from free text. Text that names neither is left out."""
    text = F.lower("gender")
    gender = F.when(F.contains(text, F.lit("female")), "female").when(
        F.contains(text, F.lit("male")), "male"
    )
    return (
        patients.select(gender.alias("gender"))
        .where(F.col("gender").isNotNull())
        .groupBy("gender")
        .agg(F.count("*").alias("count"))
    )


def schedule_options(dispense: DataFrame) -> DataFrame:
    """The schedules in use, sorted; neither null nor empty."""
    return (
        dispense.where(F.col("DrugSchedule").isNotNull() & (F.col("DrugSchedule") != ""))
        .select("DrugSchedule")
        .distinct()
        .orderBy("DrugSchedule")
    )


def today_stats(dispense: DataFrame, as_of: Clock) -> DataFrame:
    """Patients, dispenses and stores on the clock's day."""
    return same_day(dispense, "DispensedDate", as_of).agg(
        F.countDistinct("PatPharmSysID").alias("UniquePatients"),
        F.count("*").alias("TotalDispenses"),
        F.countDistinct("StoreId").alias("ActiveStores"),
    )


def recent_dispenses(dispense: DataFrame, n: int = 10) -> DataFrame:
    """The newest dispenses of the chain."""
    shown = ("ScriptNo", "PatPharmSysID", "Drugname", "StoreId")
    order = newest_first("DispensedDate", ("ScriptNo", "DrugVal", *shown[1:]))
    return (
        dispense.select("DispensedDate", "DrugVal", *shown)
        .orderBy(*order)
        .limit(n)
        .select(*shown, time_text(F.col("DispensedDate")).alias("DispensedDate"))
    )
