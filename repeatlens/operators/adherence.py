"""Whether patients collect the repeats of their prescriptions.

A script is expected to be dispensed ``TotalRepeats + 1`` times: the original
and its repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import Clock, days_between
from ..functions.values import whole_average
from .filters import dispense_filter, present
from .ranking import number_rows, top_rows
from .volumes import per_store

SCRIPT_KEYS = ["PatPharmSysID", "OriginalScriptNumber", "Drugname", "StoreId", "TotalRepeats"]

# A drug needs this many patients to count as chronic medication,
# and a script this many repeats to count as long-term.
CHRONIC_MIN_PATIENTS = 10
LONG_TERM_REPEATS = 5


def _rows(dispense, as_of, days, store_id, drug, min_repeats, *required) -> DataFrame:
    rows = dispense_filter(
        dispense, as_of, days, store_id, drug=drug, min_repeats=min_repeats
    )
    return present(rows, "PatPharmSysID", *required)


def script_fills(rows: DataFrame) -> DataFrame:
    """One row per script with everything the script-level panels need."""
    return rows.groupBy(*SCRIPT_KEYS).agg(
        F.count("*").alias("DispensedRepeats"),
        F.min("DispensedDate").alias("FirstDispense"),
        F.max("DispensedDate").alias("LastDispense"),
        F.max("RepeatNo").alias("HighestRepeatNo"),
    )


def patient_scripts(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
) -> DataFrame:
    """Fills, first and last dispense of every script."""
    rows = _rows(dispense, as_of, days, store_id, drug, min_repeats, "OriginalScriptNumber")
    return with_span(script_fills(rows))


def with_span(fills: DataFrame) -> DataFrame:
    return fills.select(
        *SCRIPT_KEYS,
        "DispensedRepeats",
        "FirstDispense",
        "LastDispense",
        days_between(F.col("FirstDispense"), F.col("LastDispense")).alias("DaysBetween"),
    )


def _rate() -> Column:
    """Share of the expected fills that were collected, in percent."""
    fills = F.col("DispensedRepeats").cast("double")
    return fills / (F.col("TotalRepeats") + 1) * 100


def adherence_summary(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    by_store: bool = False,
) -> DataFrame:
    """Scripts by compliance class, patients, and the mean compliance rate."""
    scripts = patient_scripts(dispense, as_of, days, store_id, drug, min_repeats)
    return summarise_scripts(scripts, by_store)


def summarise_scripts(scripts: DataFrame, by_store: bool = False) -> DataFrame:
    fills = F.col("DispensedRepeats")
    expected = F.col("TotalRepeats") + 1
    return scripts.groupBy(*per_store(by_store)).agg(
        F.count("*").alias("TotalScripts"),
        F.count_if(fills == expected).alias("FullyCompliantScripts"),
        # More than 80 % and less than 50 % of the expected fills, in whole numbers.
        F.count_if(fills * 5 > expected * 4).alias("HighCompliantScripts"),
        F.count_if(fills * 2 < expected).alias("LowCompliantScripts"),
        F.countDistinct("PatPharmSysID").alias("TotalPatients"),
        F.avg(_rate()).alias("OverallComplianceRate"),
    )


def medication_compliance(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    n: int = 10,
    by_store: bool = False,
) -> DataFrame:
    """Compliance of the drugs with most scripts."""
    rows = _rows(dispense, as_of, days, store_id, drug, min_repeats, "OriginalScriptNumber")
    keys = [k for k in SCRIPT_KEYS if by_store or k != "StoreId"]
    fills = rows.groupBy(*keys).agg(F.count("*").alias("DispensedRepeats"))
    return rank_medications(fills, n, by_store)


def rank_medications(fills: DataFrame, n: int = 10, by_store: bool = False) -> DataFrame:
    keys = per_store(by_store)
    rated = fills.withColumn("_rate", _rate())
    drugs = rated.groupBy(*keys, "Drugname").agg(
        F.count("*").alias("TotalScripts"),
        F.countDistinct("PatPharmSysID").alias("TotalPatients"),
        F.avg("_rate").alias("AvgComplianceRate"),
        F.count_if(F.col("_rate") >= 100).alias("FullyCompliant"),
        F.count_if(F.col("_rate") < 50).alias("LowCompliance"),
    )
    order = [F.desc("TotalScripts"), F.col("Drugname").asc_nulls_first()]
    return top_rows(drugs, n, order, keys or None)


def compliance_by_repeat(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    by_store: bool = False,
) -> DataFrame:
    """Dispenses per repeat number; numbers above five share one bucket, last."""
    keys = per_store(by_store)
    rows = _rows(dispense, as_of, days, store_id, drug, min_repeats, "RepeatNo")
    repeat = F.col("RepeatNo")
    place = F.when(repeat > 5, 999).otherwise(repeat)
    return (
        rows.groupBy(*keys, place.alias("_place"))
        .agg(
            F.count("*").alias("TotalDispenses"),
            F.countDistinct("PatPharmSysID").alias("UniquePatients"),
            whole_average(
                days_between(F.col("DatePrescribed"), F.col("DispensedDate"))
            ).alias("AvgDaysFromPrescription"),
        )
        .orderBy(*keys, "_place")
        .select(
            *keys,
            F.when(F.col("_place") == 999, "5+")
            .otherwise(F.col("_place").cast("string"))
            .alias("RepeatNo"),
            "TotalDispenses",
            "UniquePatients",
            "AvgDaysFromPrescription",
        )
    )


def medication_gaps(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    n: int | None = 20,
    by_store: bool = False,
) -> DataFrame:
    """Scripts that have not reached their last repeat, most missed fills first.

    ``n=None`` returns every such script. Missed fills can be negative when a
    repeat was dispensed more than once.
    """
    rows = _rows(dispense, as_of, days, store_id, drug, min_repeats, "OriginalScriptNumber")
    return rank_gaps(script_fills(rows), n, by_store)


def rank_gaps(fills: DataFrame, n: int | None = 20, by_store: bool = False) -> DataFrame:
    gaps = fills.where(F.col("HighestRepeatNo") < F.col("TotalRepeats")).select(
        "PatPharmSysID",
        "OriginalScriptNumber",
        "Drugname",
        "StoreId",
        "TotalRepeats",
        F.col("DispensedRepeats").alias("ActualRepeats"),
        "HighestRepeatNo",
        (F.col("TotalRepeats") + 1 - F.col("DispensedRepeats")).alias("MissedRepeats"),
    )
    order = [
        F.desc("MissedRepeats"),
        F.desc("TotalRepeats"),
        F.asc("PatPharmSysID"),
        F.asc("OriginalScriptNumber"),
        F.col("Drugname").asc_nulls_first(),
        F.col("StoreId").asc_nulls_first(),
    ]
    return gaps if n is None else top_rows(gaps, n, order, per_store(by_store) or None)


def chronic_medications(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
    n: int = 15,
    by_store: bool = False,
) -> DataFrame:
    """Drugs with the largest share of long-term scripts among their dispenses."""
    rows = _rows(dispense, as_of, days, store_id, drug, min_repeats)
    return rank_chronic(rows.withColumn("DispensedRepeats", F.lit(1)), n, by_store)


def rank_chronic(fills: DataFrame, n: int = 15, by_store: bool = False) -> DataFrame:
    """Takes rows that stand for ``DispensedRepeats`` dispenses each."""
    keys = per_store(by_store)
    weight = F.col("DispensedRepeats")
    long_term = F.when(F.col("TotalRepeats") >= LONG_TERM_REPEATS, weight).otherwise(0)
    drugs = (
        fills.groupBy(*keys, "Drugname")
        .agg(
            F.countDistinct("PatPharmSysID").alias("TotalPatients"),
            F.sum(weight).alias("TotalDispenses"),
            F.sum(F.col("TotalRepeats") * weight).alias("_repeats"),
            F.sum(long_term).alias("LongTermScripts"),
        )
        .where(F.col("TotalPatients") >= CHRONIC_MIN_PATIENTS)
        .select(
            *keys,
            "Drugname",
            "TotalPatients",
            "TotalDispenses",
            (F.col("_repeats").cast("double") / F.col("TotalDispenses")).alias("AvgTotalRepeats"),
            "LongTermScripts",
            (F.col("LongTermScripts").cast("double") / F.col("TotalDispenses") * 100).alias(
                "ChronicMedicationRate"
            ),
        )
    )
    order = [
        F.desc("ChronicMedicationRate"),
        F.desc("TotalPatients"),
        F.col("Drugname").asc_nulls_first(),
    ]
    return top_rows(drugs, n, order, keys or None)


def repeat_sequence(
    dispense: DataFrame,
    as_of: Clock | None = None,
    days: int | None = None,
    store_id=None,
    drug: str | None = None,
    min_repeats: int = 2,
) -> DataFrame:
    """The position of each dispense within its script, by repeat number.

    Dispenses with the same repeat number follow each other by date, drug and
    number of repeats.
    """
    rows = _rows(
        dispense, as_of, days, store_id, drug, min_repeats, "OriginalScriptNumber", "StoreId"
    )
    return number_rows(
        rows,
        ["StoreId", "PatPharmSysID", "OriginalScriptNumber"],
        ["RepeatNo", "DispensedDate", "Drugname", "TotalRepeats"],
    ).withColumnRenamed("_position", "ExpectedSequence")
