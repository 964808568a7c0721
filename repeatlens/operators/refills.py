"""Patient contacts, latest dispenses and refill predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import (
    Clock,
    date_text,
    day_start,
    days_between,
    moment,
    plus_days,
    shifted,
    to_clock,
)
from .filters import for_store, matched, present, recent_window
from .ranking import DISPENSE_TIES, dense_ids, first_per_group, newest_first
from .volumes import per_store

# Days from a dispense to its predicted refill, and how far back
# a dispense still counts.
REFILL_AFTER_DAYS = 30
LOOK_BACK_DAYS = 44

# The urgency classes, most urgent first.
URGENCY_CLASSES = (
    "Overdue",
    "Due Today",
    "Due Tomorrow",
    "Due This Week",
    "Due Next Week",
    "Due Later",
)

REFILL_KEYS = ("StoreId", "PatPharmSysID", "Drugname")


def build_patient_contacts(patients: DataFrame, as_of: Clock, dense: bool = False) -> DataFrame:
    """One contact row per patient and store, with a synthetic address.

    The id is unique and drawn per run: save the result before using it. With ``dense``
    ids are 1, 2, ... by patient and store, the same in every run; that stores the
    patients in sorted ranges first.
    """
    known = present(patients, "dispenseid").select(
        F.col("dispenseid").cast("string").alias("patientid"),
        F.col("storeid").cast("long").alias("storeid"),
    )
    email = F.concat(F.lit("patient"), F.col("patientid"), F.lit("@example.com"))
    known = known.distinct()
    if dense:
        known = dense_ids(known, ["patientid", "storeid"])
    else:
        known = known.withColumn("id", F.monotonically_increasing_id())
    return known.select(
        "id",
        "patientid",
        "storeid",
        email.alias("contactemail"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )


def dispense_with_contact(dispense: DataFrame, contacts: DataFrame) -> DataFrame:
    """Dispenses of patients with contact data at the same store, and the address.

    Contacts are reduced to one row per patient and store first, so the join
    never multiplies dispenses.
    """
    reachable = (
        present(contacts, "patientid", "storeid")
        .groupBy(
            F.col("patientid").cast("string").alias("_patient"),
            F.col("storeid").cast("long").alias("_store"),
        )
        .agg(F.min("contactemail").alias("ContactEmail"))
    )
    keyed = dispense.withColumns(
        {
            "_patient": F.col("PatPharmSysID").cast("string"),
            "_store": F.col("StoreId").cast("long"),
        }
    )
    keyed = present(keyed, "_patient", "_store")
    return matched(keyed, reachable, ["_patient", "_store"], "inner").drop("_patient", "_store")


def latest_dispense(
    dispense: DataFrame, keys: tuple[str, ...] = REFILL_KEYS, ties: tuple[str, ...] = DISPENSE_TIES
) -> DataFrame:
    """The newest dispense of every patient and drug in a store."""
    return first_per_group(dispense, list(keys), newest_first("DispensedDate", ties))


def refill_urgency(predicted: Column, as_of: Clock) -> Column:
    """Urgency class of a predicted refill.

    The first three classes compare calendar days; the week classes end at the
    clock's time of day.
    """
    tests = [
        predicted < moment(day_start(as_of)),
        predicted < moment(day_start(as_of, 1)),
        predicted < moment(day_start(as_of, 2)),
        predicted <= moment(shifted(as_of, 7)),
        predicted <= moment(shifted(as_of, 14)),
    ]
    label = F.lit(URGENCY_CLASSES[-1])
    for test, name in reversed(list(zip(tests, URGENCY_CLASSES))):
        label = F.when(test, name).otherwise(label)
    return label


def _urgency_rank(urgency: Column) -> Column:
    rank = F.lit(len(URGENCY_CLASSES) - 1)
    for place, name in enumerate(URGENCY_CLASSES[:-1]):
        rank = F.when(urgency == name, place).otherwise(rank)
    return rank


def due_refills(
    dispense: DataFrame,
    contacts: DataFrame,
    as_of: Clock,
    days: int = 3,
    store_id=None,
    require_drug: bool = True,
) -> DataFrame:
    """Latest dispenses with repeats left whose refill falls due within ``days``.

    The contact join comes after the latest-row step. Its keys are part of the
    ranking's groups, so it keeps or drops whole groups and the order does not
    matter for the result; this way only the few due rows are joined.
    """
    rows = recent_window(for_store(dispense, store_id), "DispensedDate", as_of, LOOK_BACK_DAYS)
    rows = present(rows.where(F.col("TotalRepeats") > 1), "PatPharmSysID", "StoreId")
    if require_drug:
        rows = present(rows, "Drugname")
    due = due_of_latest(latest_dispense(rows), as_of, days)
    return dispense_with_contact(due, for_store(contacts, store_id, "storeid"))


def due_of_latest(latest: DataFrame, as_of: Clock, days: int) -> DataFrame:
    """Of latest dispenses those with repeats left whose refill falls due."""
    return (
        latest.where(F.col("RepeatNo") < F.col("TotalRepeats"))
        .withColumn("PredictedRefillDate", plus_days(F.col("DispensedDate"), REFILL_AFTER_DAYS))
        .where(F.col("PredictedRefillDate") <= moment(shifted(as_of, int(days))))
    )


def refill_predictions(
    dispense: DataFrame, contacts: DataFrame, as_of: Clock, days: int = 3, store_id=None
) -> DataFrame:
    """The refills that fall due, most urgent first."""
    return list_due(due_refills(dispense, contacts, as_of, days, store_id), as_of)


def list_due(due: DataFrame, as_of: Clock) -> DataFrame:
    predicted = F.col("PredictedRefillDate")
    classed = due.withColumn("Urgency", refill_urgency(predicted, as_of))
    return classed.orderBy(
        _urgency_rank(F.col("Urgency")), predicted, "PatPharmSysID", "StoreId", "Drugname"
    ).select(
        "StoreId",
        F.col("PatPharmSysID").alias("PatientId"),
        "Drugname",
        "BrandName",
        "TotalRepeats",
        "RepeatNo",
        (F.col("TotalRepeats") - F.col("RepeatNo")).alias("RepeatsRemaining"),
        date_text(F.col("DispensedDate")).alias("LastDispenseDate"),
        date_text(predicted).alias("PredictedRefillDate"),
        "ContactEmail",
        "Urgency",
        days_between(F.lit(to_clock(as_of).date()), predicted).alias("DaysUntilDue"),
    )


def refill_summary(
    dispense: DataFrame,
    contacts: DataFrame,
    as_of: Clock,
    days: int = 3,
    store_id=None,
    by_store: bool = False,
) -> DataFrame:
    """Counts over the due refills. Unlike the list it includes rows without a
    drug name, so its total can be larger."""
    due = due_refills(dispense, contacts, as_of, days, store_id, require_drug=False)
    return summarise_due(due, as_of, days, by_store)


def summarise_due(due: DataFrame, as_of: Clock, days: int, by_store: bool = False) -> DataFrame:
    predicted = F.col("PredictedRefillDate")
    today, tomorrow = moment(day_start(as_of)), moment(day_start(as_of, 1))
    return due.groupBy(*per_store(by_store)).agg(
        F.count("*").alias("TotalPredictions"),
        F.count_if(predicted < today).alias("Overdue"),
        F.count_if((predicted >= today) & (predicted < tomorrow)).alias("DueToday"),
        F.count_if(predicted <= moment(shifted(as_of, 7))).alias("DueThisWeek"),
        F.count_if(predicted <= moment(shifted(as_of, int(days)))).alias("DueInSelectedPeriod"),
        F.countDistinct("PatPharmSysID").alias("UniquePatients"),
    )
