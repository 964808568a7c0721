"""Store lists, look-ups and per-store activity.

The fact table is always grouped by store before it meets the store table, so
the joins move one row per store. No join carries a broadcast hint: the grouped
sides are measured at run time and adaptive execution broadcasts the small ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import time_text
from ..functions.text import any_contains, short_brand, store_label
from ..functions.values import active_flag, active_text, integration_text, or_zero
from . import distinct
from .filters import for_store, present
from .monitoring import barcode_counts, heartbeat_pings, last_sale, stock_counts


def store_list(stores: DataFrame) -> DataFrame:
    """Id, name, state and active flag of every store, by name."""
    return stores.select(
        "PharmacyID",
        F.col("CommercialName").alias("StoreName"),
        F.col("TimeZoneState").alias("State"),
        active_flag(F.col("ExcludeHC")).alias("IsActive"),
    ).orderBy("StoreName", "PharmacyID")


def store_detail(stores: DataFrame, store_id=None) -> DataFrame:
    """The contact sheet of one store, or of all stores."""
    return for_store(stores, store_id, "PharmacyID").select(
        "PharmacyID",
        F.col("CommercialName").alias("StoreName"),
        F.col("TimeZoneState").alias("State"),
        F.col("ContactPerson1").alias("ContactPerson"),
        "ContactNumber",
        "PharmacyGroupId",
        F.col("CommentsHC").alias("Notes"),
        active_flag(F.col("ExcludeHC")).alias("IsActive"),
        "UpdatedDate",
        F.col("IsActive").alias("DatabaseIsActive"),
        "ContactPerson2",
        "BestContactTime",
    )


def store_lookup(stores: DataFrame, store_id=None) -> DataFrame:
    """The older id lookup, whose status needs a known exclusion flag."""
    return for_store(stores, store_id, "PharmacyID").select(
        "PharmacyID",
        F.col("CommercialName").alias("StoreName"),
        "ContactPerson1",
        "ContactNumber",
        F.col("TimeZoneState").alias("State"),
        active_text(F.col("ExcludeHC"), legacy=True).alias("Status"),
    )


def search_stores(stores: DataFrame, term: str = "") -> DataFrame:
    """The store list narrowed by a case-insensitive substring of id, name or
    state. An empty term keeps every store."""
    listed = store_list(stores)
    if not term:
        return listed
    columns = [F.col("PharmacyID").cast("string"), F.col("StoreName"), F.col("State")]
    return listed.where(any_contains(columns, term))


def _store_names(stores: DataFrame) -> DataFrame:
    return stores.select(
        F.col("PharmacyID").cast("string").alias("_store"),
        F.col("CommercialName").alias("_name"),
    )


def _with_names(per_store: DataFrame, stores: DataFrame, store_column: str) -> DataFrame:
    """Left join of one-row-per-store data to the store names. Store ids have
    different types in different tables, so they meet as text."""
    return per_store.withColumn("_store", F.col(store_column).cast("string")).join(
        _store_names(stores), "_store", "left"
    )


def store_filter_options(dispense: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores that dispensed something, with their names where known, by id."""
    seen = present(dispense, "StoreId").select("StoreId").distinct()
    return (
        _with_names(seen, stores, "StoreId")
        .select(F.col("StoreId").alias("storeId"), F.col("_name").alias("storeName"))
        .orderBy("storeId")
    )


def adherence_stores(dispense: DataFrame, stores: DataFrame, min_rows: int = 100) -> DataFrame:
    """Stores with more than ``min_rows`` dispenses, most first."""
    counted = (
        present(dispense, "StoreId")
        .groupBy("StoreId")
        .agg(F.count("*").alias("recordCount"))
        .where(F.col("recordCount") > min_rows)
    )
    return (
        _with_names(counted, stores, "StoreId")
        .select(
            F.col("StoreId").alias("storeId"),
            short_brand(store_label(F.col("_name"), F.col("StoreId"))).alias("storeName"),
            "recordCount",
        )
        .orderBy(F.desc("recordCount"), "storeId")
    )


def contact_patients_per_store(contacts: DataFrame) -> DataFrame:
    """Distinct patients with contact data per store."""
    return contacts.groupBy("storeid").agg(F.countDistinct("patientid").alias("patientCount"))


def refill_stores(contacts: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores with contact data, most patients first."""
    return (
        _with_names(contact_patients_per_store(contacts), stores, "storeid")
        .select(
            F.col("storeid").alias("storeId"),
            short_brand(store_label(F.col("_name"), F.col("storeid"))).alias("storeName"),
            "patientCount",
        )
        .orderBy(F.desc("patientCount"), "storeId")
    )


def _onto_stores(stores: DataFrame, per_store: DataFrame, key: str, store_id=None) -> DataFrame:
    """Every store with its measures, null where the store has none."""
    base = for_store(stores, store_id, "PharmacyID").withColumn(
        "_store", F.col("PharmacyID").cast("string")
    )
    keyed = per_store.withColumn("_store", F.col(key).cast("string")).drop(key)
    return base.join(keyed, "_store", "left")


def store_activity(stores: DataFrame, dispense: DataFrame, store_id=None) -> DataFrame:
    """Distinct patients and scripts per store over all time. Stores without
    dispenses stay, with zeros."""
    activity = (
        for_store(dispense, store_id)
        .groupBy("StoreId")
        .agg(
            F.countDistinct("PatPharmSysID").alias("patients"),
            F.countDistinct("OriginalScriptNumber").alias("scripts"),
        )
    )
    return _activity(stores, activity, store_id)


def store_activity_of_bitmaps(
    stores: DataFrame, patients: DataFrame, scripts: DataFrame, store_id=None
) -> DataFrame:
    """``store_activity`` from bitmaps of patients and of scripts (``distinct.bitmaps`` with
    StoreId as the group) of any number of periods."""
    counts = distinct.counted(for_store(patients, store_id), ["StoreId"], "patients").join(
        distinct.counted(for_store(scripts, store_id), ["StoreId"], "scripts"), "StoreId", "full"
    )
    return _activity(stores, counts, store_id)


def _activity(stores: DataFrame, counts: DataFrame, store_id) -> DataFrame:
    return _onto_stores(stores, counts, "StoreId", store_id).select(
        F.col("PharmacyID").alias("StoreId"),
        F.col("CommercialName").alias("StoreName"),
        F.col("TimeZoneState").alias("State"),
        or_zero(F.col("patients")).alias("UniquePatients"),
        or_zero(F.col("scripts")).alias("UniqueScripts"),
    )


def store_contacts(stores: DataFrame, contacts: DataFrame, store_id=None) -> DataFrame:
    """Patients with contact data per store, zero included."""
    counted = contact_patients_per_store(for_store(contacts, store_id, "storeid"))
    return _onto_stores(stores, counted, "storeid", store_id).select(
        F.col("PharmacyID").alias("StoreId"),
        F.col("CommercialName").alias("StoreName"),
        F.col("TimeZoneState").alias("State"),
        or_zero(F.col("patientCount")).alias("ConfiguredPatients"),
    )


def patient_count_fallback(
    wh_patients: DataFrame, dispense: DataFrame, store_id=None
) -> DataFrame:
    """Distinct patients per store from the patient table, or from the dispenses
    for a store the patient table does not know."""
    registered = (
        present(for_store(wh_patients, store_id), "StoreId")
        .groupBy(F.col("StoreId").cast("string").alias("StoreId"))
        .agg(F.countDistinct("PatientId").alias("registered"))
    )
    dispensed = (
        present(for_store(dispense, store_id), "StoreId")
        .groupBy(F.col("StoreId").cast("string").alias("StoreId"))
        .agg(F.countDistinct("PatPharmSysID").alias("dispensed"))
    )
    return registered.join(dispensed, "StoreId", "full").select(
        "StoreId", F.coalesce("registered", "dispensed", F.lit(0)).alias("TotalPatients")
    )


def registered_patients(wh_patients: DataFrame, store_id=None) -> DataFrame:
    """Distinct patients per store by the patient table."""
    return _patients(wh_patients, "PatientId", store_id)


def dispensed_patients(dispense: DataFrame, store_id=None) -> DataFrame:
    """Distinct patients per store by the dispenses, for when the patient table can not be
    read (``tables.first_that_runs`` picks the first of both that can)."""
    return _patients(dispense, "PatPharmSysID", store_id)


def _patients(df: DataFrame, patient: str, store_id) -> DataFrame:
    return (
        present(for_store(df, store_id), "StoreId")
        .groupBy(F.col("StoreId").cast("string").alias("StoreId"))
        .agg(F.countDistinct(patient).alias("TotalPatients"))
    )


def store_360(
    stores: DataFrame,
    sales: DataFrame,
    stock: DataFrame,
    ean_links: DataFrame,
    wh_patients: DataFrame,
    dispense: DataFrame,
    pings: DataFrame,
    store_id=None,
) -> DataFrame:
    """One row per store from all sources; a missing source counts as zero.

    Heartbeats are shown only for stores whose integration is switched on.
    """
    result = for_store(stores, store_id, "PharmacyID").withColumn(
        "_store", F.col("PharmacyID").cast("string")
    )
    measures = [
        last_sale(sales, store_id),
        stock_counts(stock, store_id),
        barcode_counts(ean_links, store_id),
        patient_count_fallback(wh_patients, dispense, store_id),
        heartbeat_pings(pings, store_id),
    ]
    for measure in measures:
        keyed = measure.withColumn("_store", F.col("StoreId").cast("string")).drop("StoreId")
        result = result.join(keyed, "_store", "left")
    integrated = F.col("BIRExtractionFlag") == 1
    return result.select(
        F.col("PharmacyID").alias("StoreId"),
        F.col("CommercialName").alias("StoreName"),
        F.col("TimeZoneState").alias("State"),
        F.col("ContactPerson1").alias("ContactPerson"),
        "ContactNumber",
        active_text(F.col("ExcludeHC")).alias("Status"),
        integration_text(F.col("BIRExtractionFlag")).alias("BIRStatus"),
        "LastSalesDate",
        or_zero(F.col("TotalRecords")).alias("TotalSales"),
        or_zero(F.col("StockCount")).alias("StockCount"),
        or_zero(F.col("UniqueBarcodes")).alias("UniqueBarcodes"),
        or_zero(F.col("TotalLinks")).alias("TotalLinks"),
        or_zero(F.col("TotalPatients")).alias("TotalPatients"),
        F.when(integrated, time_text(F.col("lastping"))).alias("LastPing"),
        F.when(integrated, time_text(F.col("previousping"))).alias("PreviousPing"),
    )
