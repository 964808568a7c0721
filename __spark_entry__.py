"""

Every query reads its whole tables for all stores. ``_plain`` only fits results
for comparison across engines: dates and times become text, digits of doubles
beyond the compared ones are rounded off. The operators return them unchanged.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from repeatlens.operators import (  # noqa: E402
    access,
    adherence,
    distinct,
    filters,
    messages,
    monitoring,
    paging,
    profile,
    refills,
    rules,
    stores,
    text_index,
    volumes,
)
from repeatlens.plans import refill_state, reports, rollup  # noqa: E402
from repeatlens.sources import export, seeding  # noqa: E402
from repeatlens.sources.sample import DISPENSE_CLOCK, EVENT_CLOCK, sample_tables  # noqa: E402
from repeatlens.sources.tables import Tables, first_that_runs, load_tables, run_sql  # noqa: E402

try:  # the text operators are an optional part
    from repeatlens.llm import queries as text_queries  # noqa: E402
except ImportError:
    text_queries = None

# The refill list looks a month ahead here, which fills every urgency class.
REFILL_DAYS = 30

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    fitted = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("date", "timestamp", "timestamp_ntz"):
            fitted[field.name] = F.col(f"`{field.name}`").cast("string")
        elif kind == "double":
            digits = 2 if field.name == "totalValue" else 6
            fitted[field.name] = F.round(F.col(f"`{field.name}`"), digits)
    return df.withColumns(fitted) if fitted else df


def _rules() -> tuple[monitoring.IgnoreRule, ...]:
    """The shipped rules with the regular expression switched on, and one that
    does not compile and must be passed over."""
    regex = monitoring.DEFAULT_RULES[-1]
    return (
        *monitoring.DEFAULT_RULES[:-1],
        monitoring.IgnoreRule("broken(", "never applies", is_regex=True),
        monitoring.IgnoreRule(regex.pattern, regex.description, is_regex=True),
    )


def _exported(t: Tables, spark: SparkSession) -> DataFrame:
    refill_list = refills.refill_predictions(t.dispense, t.contacts, DISPENSE_CLOCK, REFILL_DAYS)
    path = export.export_refills_csv(refill_list, export.shared_folder(spark, "refills"))
    return export.read_refills_csv(spark, path)


def _sql_by_parameters(t: Tables, spark: SparkSession) -> DataFrame:
    view = f"sales_{uuid.uuid4().hex}"  # a name of its own: the caller may have a view sales
    t.sales.createOrReplaceTempView(view)
    result = run_sql(
        spark,
        f"SELECT StoreId, count(*) AS TotalSales FROM {view}"
        " WHERE SalesDate >= :since GROUP BY StoreId",
        since="1998-01-01",
    )
    spark.catalog.dropTempView(view)
    return result


def _counted_tables(t: Tables) -> dict[str, DataFrame]:
    names = ("dispense", "stores", "patients", "sales", "ean_links", "errors", "users", "messages")
    return t.as_dict(names)


_DISPENSE_ORDER = ["DispensedDate", "ScriptNo", "DrugVal"]
_D, _E = DISPENSE_CLOCK, EVENT_CLOCK

# Key -> result, from the domain tables.
_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # Stores
    "store_list": lambda t: stores.store_list(t.stores),
    "store_detail": lambda t: stores.store_detail(t.stores),
    "store_lookup": lambda t: stores.store_lookup(t.stores),
    "search_stores": lambda t: stores.search_stores(t.stores, "chemist"),
    "store_filter_options": lambda t: stores.store_filter_options(t.dispense, t.stores),
    "adherence_stores": lambda t: stores.adherence_stores(t.dispense, t.stores),
    "refill_stores": lambda t: stores.refill_stores(t.contacts, t.stores),
    "store_activity": lambda t: stores.store_activity(t.stores, t.dispense),
    "store_contacts": lambda t: stores.store_contacts(t.stores, t.contacts),
    "patient_count_fallback": lambda t: stores.patient_count_fallback(t.wh_patients, t.dispense),
    "store_360": lambda t: stores.store_360(
        t.stores, t.sales, t.stock, t.ean_links, t.wh_patients, t.dispense, t.pings
    ),
    # Volumes
    "dispense_filter": lambda t: filters.dispense_filter(
        t.dispense, _D, days=365, schedule="ECONOMY", drug="RING", min_repeats=3
    ),
    "dispense_summary": lambda t: volumes.dispense_summary(t.dispense, _D),
    "dispense_summary_by_store": lambda t: volumes.dispense_summary(
        t.dispense, _D, days=365, by_store=True
    ),
    "patient_total": lambda t: volumes.patient_total(t.patients),
    "daily_trend": lambda t: volumes.daily_trend(t.dispense, _D),
    "daily_trend_by_store": lambda t: volumes.daily_trend(t.dispense, _D, by_store=True),
    "top_drugs": lambda t: volumes.top_drugs(t.dispense, _D),
    "top_drugs_by_store": lambda t: volumes.top_drugs(t.dispense, _D, n=3, by_store=True),
    "schedule_mix": lambda t: volumes.schedule_mix(t.dispense, _D),
    "schedule_mix_by_store": lambda t: volumes.schedule_mix(t.dispense, _D, by_store=True),
    "store_ranking": lambda t: volumes.store_ranking(t.dispense, _D, days=90),
    "gender_mix": lambda t: volumes.gender_mix(t.patients),
    "schedule_options": lambda t: volumes.schedule_options(t.dispense),
    "today_stats": lambda t: volumes.today_stats(t.dispense, _D),
    "recent_dispenses": lambda t: volumes.recent_dispenses(t.dispense),
    # Adherence
    "patient_scripts": lambda t: adherence.patient_scripts(t.dispense, _D),
    "adherence_summary": lambda t: adherence.adherence_summary(t.dispense, _D),
    "adherence_summary_by_store": lambda t: adherence.adherence_summary(
        t.dispense, _D, by_store=True
    ),
    "medication_compliance": lambda t: adherence.medication_compliance(t.dispense, _D),
    "medication_compliance_by_store": lambda t: adherence.medication_compliance(
        t.dispense, _D, by_store=True
    ),
    "compliance_by_repeat": lambda t: adherence.compliance_by_repeat(t.dispense, _D),
    "compliance_by_repeat_by_store": lambda t: adherence.compliance_by_repeat(
        t.dispense, _D, by_store=True
    ),
    "medication_gaps": lambda t: adherence.medication_gaps(t.dispense, _D),
    "medication_gaps_all": lambda t: adherence.medication_gaps(t.dispense, _D, n=None),
    "medication_gaps_by_store": lambda t: adherence.medication_gaps(
        t.dispense, _D, by_store=True
    ),
    "chronic_medications_by_store": lambda t: adherence.chronic_medications(
        t.dispense, _D, by_store=True
    ),
    "chronic_medications": lambda t: adherence.chronic_medications(t.dispense, _D),
    "repeat_sequence": lambda t: adherence.repeat_sequence(t.dispense),
    # Refills
    "build_patient_contacts": lambda t: refills.build_patient_contacts(t.patients, _D).select(
        "patientid", "storeid", "contactemail"
    ),
    "dense_patient_contacts": lambda t: refills.build_patient_contacts(
        t.patients, _D, dense=True
    ).select("id", "patientid", "storeid", "contactemail"),
    "dispense_with_contact": lambda t: refills.dispense_with_contact(
        t.dispense, t.contacts
    ).select("StoreId", "PatPharmSysID", "ScriptNo", "DispensedDate", "ContactEmail"),
    "latest_dispense": lambda t: refills.latest_dispense(t.dispense).select(
        "StoreId", "PatPharmSysID", "Drugname", "DispensedDate", "ScriptNo", "RepeatNo"
    ),
    "refill_predictions": lambda t: refills.refill_predictions(
        t.dispense, t.contacts, _D, REFILL_DAYS
    ),
    "refill_summary": lambda t: refills.refill_summary(t.dispense, t.contacts, _D, REFILL_DAYS),
    "refill_summary_by_store": lambda t: refills.refill_summary(
        t.dispense, t.contacts, _D, REFILL_DAYS, by_store=True
    ),
    # Monitoring
    "last_sale": lambda t: monitoring.last_sale(t.sales),
    "last_dispense": lambda t: monitoring.last_dispense(t.dispense),
    "stock_counts": lambda t: monitoring.stock_counts(t.stock),
    "barcode_counts": lambda t: monitoring.barcode_counts(t.ean_links),
    "heartbeat_pings": lambda t: monitoring.heartbeat_pings(t.pings),
    "heartbeat_status": lambda t: monitoring.heartbeat_status(t.stores, t.pings, _E).withColumn(
        "MinutesSinceLast", F.col("MinutesSinceLast").cast("string")
    ),
    "recent_errors": lambda t: monitoring.recent_errors(t.errors, _E),
    "error_type_summary": lambda t: monitoring.error_type_summary(t.errors, _E),
    "error_type_summary_all": lambda t: monitoring.error_type_summary(t.errors, _E, cap=None),
    "error_source_summary": lambda t: monitoring.error_source_summary(t.errors, _E),
    "flag_ignored_errors": lambda t: monitoring.flag_ignored_errors(t.errors, _rules()).select(
        "ErrorID", "ErrorMessage", "IsIgnored", "IgnoreReason"
    ),
    # Users, roles and permissions
    "dashboard_counts": lambda t: access.dashboard_counts(t.stores, t.users),
    "active_roles": lambda t: access.active_roles(t.roles),
    "role_permission_matrix": lambda t: access.role_permission_matrix(t.roles, t.permissions),
    "user_permissions": lambda t: access.user_permissions(
        t.users, t.roles, t.role_permissions, t.permissions
    ),
    "users_with_roles": lambda t: access.users_with_roles(t.users, t.roles),
    "search_users": lambda t: access.search_users(t.users, t.roles, "analyst"),
    "lookup_by_keys": lambda t: filters.lookup_by_keys(
        t.users.select("Userid", "Username"),
        t.dispense.select(F.col("PatPharmSysID").cast("bigint").alias("Userid")),
        ["Userid"],
    ),
    "not_exists_insert": lambda t: filters.not_exists_insert(
        t.users.select("Userid", "Username"),
        t.dispense.select(F.col("PatPharmSysID").cast("bigint").alias("Userid")),
        ["Userid"],
    ),
    "page_rows": lambda t: paging.page_rows(
        access.users_with_roles(t.users, t.roles), [F.desc("CreatedDate"), "Userid"], page=2
    ),
    "page_count": lambda t: paging.page_count(t.users),
    # Messages
    "message_tags": lambda t: messages.tag_messages(t.messages),
    "message_intents": lambda t: messages.message_intents(t.messages),
    # Profiles
    "column_profile": lambda t: profile.column_profile(t.dispense),
    "sample_rows": lambda t: profile.sample_rows(t.dispense, 3, _DISPENSE_ORDER),
    "date_coverage": lambda t: profile.date_coverage(t.dispense, "DispensedDate"),
    "dispenses_per_store": lambda t: profile.dispenses_per_store(t.dispense),
    "table_row_counts": lambda t: profile.table_row_counts(_counted_tables(t)),
    "table_profile": lambda t: reports.profile_lines(t.dispense, "DispensedDate", "StoreId"),
}

# Report page -> its panels, and the key whose statement checks each of them.
_REPORTS: dict[str, tuple[Callable[[Tables], reports.Report], dict[str, str]]] = {
    "analytics": (
        lambda t: reports.analytics_report(t, _D),
        {
            "summary": "dispense_summary",
            "patients": "patient_total",
            "daily_trend": "daily_trend",
            "top_drugs": "top_drugs",
            "schedule_mix": "schedule_mix",
            "gender_mix": "gender_mix",
            "stores": "store_filter_options",
            "schedules": "schedule_options",
        },
    ),
    "analytics_90_days": (
        lambda t: reports.analytics_report(t, _D, days=90),
        {"store_ranking": "store_ranking"},
    ),
    "adherence": (
        lambda t: reports.adherence_report(t, _D),
        {
            "summary": "adherence_summary",
            "medication_compliance": "medication_compliance",
            "compliance_by_repeat": "compliance_by_repeat",
            "medication_gaps": "medication_gaps",
            "chronic_medications": "chronic_medications",
            "store_activity": "store_activity",
        },
    ),
    "refill": (
        lambda t: reports.refill_report(t, _D, REFILL_DAYS),
        {"predictions": "refill_predictions", "summary": "refill_summary", "store": "store_contacts"},
    ),
    "profile": (
        lambda t: reports.table_profile(t.dispense, "DispensedDate", "StoreId"),
        {"columns": "column_profile", "coverage": "date_coverage", "keys": "dispenses_per_store"},
    ),
}


def _panel(build: Callable[[Tables], reports.Report], name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: build(t)[name]


def _panels() -> dict[str, tuple[Callable[[Tables], DataFrame], str]]:
    return {
        f"{page}_report_{panel}": (_panel(build, panel), check)
        for page, (build, checks) in _REPORTS.items()
        for panel, check in checks.items()
    }


def _stored(t: Tables, spark: SparkSession) -> DataFrame:
    """The last sale of every store, from a table that was stored and loaded again."""
    folder = export.shared_folder(spark, "tables")
    export.save_table(t.sales, f"{folder}/sales.parquet")
    return monitoring.last_sale(load_tables(spark, folder).sales)


def _warehouse(t: Tables, spark: SparkSession) -> DataFrame:
    """The last dispense of every store, from a warehouse in a folder of its own."""
    folder = export.shared_folder(spark, "warehouse")
    export.save_table(t.dispense_transactions, f"{folder}/dispense_transactions.parquet")
    loaded = load_tables(spark, f"{folder}/none", warehouse=folder)
    return monitoring.last_dispense(loaded.dispense_transactions)


def _seeded(t: Tables, spark: SparkSession) -> DataFrame:
    """Patients who dispensed, then the users who are not among them; both sent twice."""
    users = t.users.select("Userid", "Username")
    folder = export.shared_folder(spark, "seeded")
    made = seeding.SeededTable(spark, folder, users.schema, ["Userid"])
    patients = filters.present(t.dispense, "PatPharmSysID").select(
        F.col("PatPharmSysID").cast("bigint").alias("Userid"), F.lit(None).alias("Username")
    )
    for _ in range(2):
        made.seed("patients", patients.distinct())
        made.seed("users", users)
    return made.read()


def _counted_by_fallback(t: Tables, spark: SparkSession) -> DataFrame:
    """Patients of every store from a patient table that is not there, so from dispenses."""
    nowhere = load_tables(spark, export.shared_folder(spark, "nowhere"))
    found = first_that_runs(
        spark,
        {
            "patients": lambda: stores.registered_patients(nowhere.wh_patients),
            "dispenses": lambda: stores.dispensed_patients(t.dispense_transactions),
        },
    )
    return found.withColumn("Failed", F.split("Reason", ":")[0]).drop("Reason")


def _flagged_by_table(t: Tables, spark: SparkSession) -> DataFrame:
    """The errors under rules that are read from a stored table."""
    path = export.shared_folder(spark, "rules")
    rules.rules_table(spark, _rules()).write.parquet(path)
    flagged = rules.flag_errors_by_table(t.errors, spark.read.parquet(path))
    return flagged.select("ErrorID", "ErrorMessage", "IsIgnored", "IgnoreReason")


def _refill_state(t: Tables, spark: SparkSession) -> refill_state.RefillState:
    """The state of the later dispenses, to which the earlier ones were added."""
    late = F.coalesce(F.col("DispensedDate") >= F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(False))
    made = refill_state.RefillState(spark, export.shared_folder(spark, "refill-state"), buckets=8)
    made = made.build(t.dispense.where(late), t.contacts)
    return made.add(t.dispense.where(~late), export.shared_folder(spark, "refill-state"))


def _rolled_up(t: Tables, spark: SparkSession, days: int | None = None) -> reports.Report:
    """The volume page from a stored rollup of which one month was counted again."""
    made = rollup.VolumeRollup(spark, export.shared_folder(spark, "rollup"), _D)
    made.build(t.dispense).replace(t.dispense, [date(1998, 2, 15)])
    return made.report(t, _D, days)


def _merged_activity(t: Tables) -> DataFrame:
    """Distinct patients and scripts of each store, merged from bitmaps of its years."""
    rows = t.dispense.withColumn("year", F.year("DispensedDate"))

    def years(column: str) -> DataFrame:
        ids = distinct.dictionary(rows, "StoreId", column)
        return distinct.bitmaps(rows, ids, "StoreId", column, per=["year"])

    bits = [years(c) for c in ("PatPharmSysID", "OriginalScriptNumber")]
    return stores.store_activity_of_bitmaps(t.stores, *bits)


def _indexed_page(t: Tables, spark: SparkSession) -> DataFrame:
    """The second page of the users, from a stored index."""
    index = paging.PageIndex(spark, export.shared_folder(spark, "pages"), ["-CreatedDate", "Userid"])
    return index.build(access.users_with_roles(t.users, t.roles)).page(2)


def _drugs_by_index(t: Tables, spark: SparkSession) -> DataFrame:
    """The filtered dispenses, their drug found among the distinct names."""
    index = text_index.TextIndex(spark, export.shared_folder(spark, "drugs"), ["Drugname"], ["Drugname"])
    index.add(t.dispense)
    found = filters.dispense_filter(t.dispense, _D, days=365, schedule="ECONOMY", min_repeats=3)
    return index.search(found, "RING", wildcards=True)


def _users_by_index(t: Tables, spark: SparkSession) -> DataFrame:
    listed = access.users_with_roles(t.users, t.roles)
    columns = ["Firstname", "Lastname", "Username", "Email", "RoleName"]
    index = text_index.TextIndex(spark, export.shared_folder(spark, "users"), ["Userid"], columns)
    return index.add(listed).search(listed, "analyst")


def _stores_by_index(t: Tables, spark: SparkSession) -> DataFrame:
    listed = stores.store_list(t.stores)
    columns = ["PharmacyID", "StoreName", "State"]
    index = text_index.TextIndex(spark, export.shared_folder(spark, "stores"), ["PharmacyID"], columns)
    return index.add(listed).search(listed, "chemist")


# The same for results that also need the session.
_SESSION_QUERIES: dict[str, Callable[[Tables, SparkSession], DataFrame]] = {
    "export_refills_csv": _exported,
    "load_tables": _stored,
    "run_sql": _sql_by_parameters,
    "rollup_summary": lambda t, spark: _rolled_up(t, spark)["summary"],
    "rollup_daily_trend": lambda t, spark: _rolled_up(t, spark)["daily_trend"],
    "rollup_top_drugs": lambda t, spark: _rolled_up(t, spark)["top_drugs"],
    "rollup_store_ranking": lambda t, spark: _rolled_up(t, spark, 90)["store_ranking"],
    "store_activity_merged": lambda t, spark: _merged_activity(t),
    "page_rows_indexed": _indexed_page,
    "dispense_filter_indexed": _drugs_by_index,
    "search_users_indexed": _users_by_index,
    "search_stores_indexed": _stores_by_index,
    "warehouse_last_dispense": _warehouse,
    "seeded_table": _seeded,
    "patient_count_of_sources": _counted_by_fallback,
    "flag_ignored_errors_by_table": _flagged_by_table,
    "refill_state_predictions": lambda t, spark: _refill_state(t, spark).predictions(_D, REFILL_DAYS),
    "refill_state_summary": lambda t, spark: _refill_state(t, spark).summary(_D, REFILL_DAYS),
}

# Keys of stored or merged forms -> the key whose statement checks them.
_SAME_AS = {
    "load_tables": "last_sale",
    "rollup_summary": "dispense_summary",
    "rollup_daily_trend": "daily_trend",
    "rollup_top_drugs": "top_drugs",
    "rollup_store_ranking": "store_ranking",
    "store_activity_merged": "store_activity",
    "page_rows_indexed": "page_rows",
    "dispense_filter_indexed": "dispense_filter",
    "search_users_indexed": "search_users",
    "search_stores_indexed": "search_stores",
    "flag_ignored_errors_by_table": "flag_ignored_errors",
    "refill_state_predictions": "refill_predictions",
    "refill_state_summary": "refill_summary",
}


def _query(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(build(sample_tables(spark, sf_dir)))


def _session_query(build: Callable[[Tables, SparkSession], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(build(sample_tables(spark, sf_dir), spark))


def entry(spark: SparkSession) -> DataFrame:
    """The refill predictions of all stores on the smallest test tables."""
    return queries()["refill_predictions"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    registered = {key: _query(build) for key, build in _QUERIES.items()}
    registered |= {key: _session_query(build) for key, build in _SESSION_QUERIES.items()}
    registered |= {key: _query(build) for key, (build, _) in _panels().items()}
    if text_queries is not None:
        registered |= text_queries.QUERIES
    return registered


def oracle_sql() -> dict[str, str]:
    checks = oracles.all_sql()
    checks |= {key: checks[check] for key, check in _SAME_AS.items()}
    checks |= {key: checks[check] for key, (_, check) in _panels().items()}
    if text_queries is not None:
        checks |= text_queries.ORACLE_SQL
    return checks
