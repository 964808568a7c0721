"""Sales, stock, error-log and heartbeat summaries per store."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import Clock, moment, time_text, whole_minutes
from ..functions.text import preview
from ..functions.values import or_label
from .filters import for_store, present, recent_window
from .ranking import first_per_group, newest_first


def last_sale(sales: DataFrame, store_id=None) -> DataFrame:
    """Last sale and number of sales rows per store.

    One grouped aggregate answers both, where a running window over the whole
    table would put a store into one task.
    """
    return (
        present(for_store(sales, store_id), "StoreId")
        .groupBy("StoreId")
        .agg(F.max("SalesDate").alias("_last"), F.count("*").alias("TotalRecords"))
        .select("StoreId", time_text(F.col("_last")).alias("LastSalesDate"), "TotalRecords")
    )


def last_dispense(dispense: DataFrame, store_id=None) -> DataFrame:
    """The newest dispense of every store and its number of dispenses, from the dispenses
    of either database.

    Date and number come out of one hash aggregate, combined before the shuffle; only the
    rows of a store's last moment are then compared for the newest one.
    """
    rows = present(for_store(dispense, store_id), "StoreId")
    last = rows.groupBy(F.col("StoreId").alias("_store")).agg(
        F.max("DispensedDate").alias("_last"), F.count("*").alias("TotalRecords")
    )
    at_last = (F.col("StoreId") == F.col("_store")) & F.col("DispensedDate").eqNullSafe(F.col("_last"))
    ties = ("ScriptNo", "DrugVal", "Drugname", "PatPharmSysID")
    order = [F.col(c).desc_nulls_last() for c in ties if c in dispense.columns]
    return first_per_group(rows.join(last, at_last), ["StoreId"], order).select(
        "StoreId",
        time_text(F.col("_last")).alias("LastDispenseDate"),
        "ScriptNo",
        "Drugname",
        "PatPharmSysID",
        "TotalRecords",
    )


def stock_counts(stock: DataFrame, store_id=None) -> DataFrame:
    return (
        present(for_store(stock, store_id), "StoreId")
        .groupBy("StoreId")
        .agg(F.count("*").alias("StockCount"))
    )


def barcode_counts(ean_links: DataFrame, store_id=None) -> DataFrame:
    """Distinct barcodes and all barcode links per store."""
    return (
        present(for_store(ean_links, store_id), "StoreId")
        .groupBy("StoreId")
        .agg(
            F.countDistinct("EAN").alias("UniqueBarcodes"),
            F.count("*").alias("TotalLinks"),
        )
    )


def heartbeat_pings(pings: DataFrame, store_id=None) -> DataFrame:
    """Last and previous ping of every store that has ping rows."""
    kept = first_per_group(
        present(for_store(pings, store_id), "StoreId").select("StoreId", "ping"),
        ["StoreId"],
        [F.col("ping").desc_nulls_last()],
        2,
    )
    newest_two = F.sort_array(F.collect_list("ping"), asc=False)
    return (
        kept.groupBy("StoreId")
        .agg(newest_two.alias("_pings"))
        .select(
            "StoreId",
            F.get("_pings", F.lit(0)).alias("lastping"),
            F.get("_pings", F.lit(1)).alias("previousping"),
        )
    )


# Minutes up to which a heartbeat is healthy, and up to which it is late.
HEALTHY_MINUTES = 30
WARNING_MINUTES = 60


def heartbeat_status(
    stores: DataFrame, pings: DataFrame, as_of: Clock, store_id=None
) -> DataFrame:
    """Heartbeat class of every store from the age of its last ping."""
    latest = heartbeat_pings(pings, store_id).select(
        F.col("StoreId").cast("string").alias("_store"),
        F.lit(True).alias("_seen"),
        "lastping",
        "previousping",
    )
    minutes = whole_minutes(F.col("lastping"), moment(as_of))
    integrated = F.coalesce(F.col("BIRExtractionFlag") == 1, F.lit(False))
    status = (
        F.when(~integrated, "Inactive")
        .when(F.col("_seen").isNull(), "NoData")
        .when(F.col("lastping").isNull(), "Unknown")
        .when(minutes <= HEALTHY_MINUTES, "Healthy")
        .when(minutes <= WARNING_MINUTES, "Warning")
        .otherwise("Critical")
    )
    return (
        for_store(stores, store_id, "PharmacyID")
        .withColumn("_store", F.col("PharmacyID").cast("string"))
        .join(latest, "_store", "left")
        .select(
            F.col("PharmacyID").alias("StoreId"),
            F.col("CommercialName").alias("StoreName"),
            status.alias("Status"),
            F.when(integrated, time_text(F.col("lastping"))).alias("LastPing"),
            F.when(integrated, time_text(F.col("previousping"))).alias("PreviousPing"),
            F.when(integrated, minutes).alias("MinutesSinceLast"),
        )
    )


def latest_errors(
    errors: DataFrame, as_of: Clock, days: int = 3, n: int | None = 50, store_id=None
) -> DataFrame:
    """Each store's latest ``n`` errors of the last days; all of them without ``n``."""
    recent = present(
        recent_window(for_store(errors, store_id, "PharmacyId"), "ErrorDate", as_of, days),
        "PharmacyId",
    )
    if n is None:
        return recent
    return first_per_group(recent, ["PharmacyId"], newest_first("ErrorDate", ("ErrorID",)), n)


def recent_errors(
    errors: DataFrame, as_of: Clock, days: int = 3, n: int = 50, store_id=None
) -> DataFrame:
    """The latest errors per store with a short message preview."""
    return latest_errors(errors, as_of, days, n, store_id).select(
        "PharmacyId",
        "ErrorID",
        "ErrorIndicator",
        "ErrorTypeUDC",
        "ErrorSource",
        "ErrorMessage",
        preview(F.col("ErrorMessage")).alias("MessagePreview"),
        "StepUDC",
        "TableName",
        time_text(F.col("ErrorDate")).alias("ErrorDate"),
    )


def _error_summary(errors, as_of, days, cap, store_id, column: str, label: str) -> DataFrame:
    return (
        latest_errors(errors, as_of, days, cap, store_id)
        .groupBy("PharmacyId", or_label(F.col(column), "Unknown").alias(label))
        .agg(F.count("*").alias("ErrorCount"))
    )


def error_type_summary(
    errors: DataFrame, as_of: Clock, days: int = 3, cap: int | None = 50, store_id=None
) -> DataFrame:
    """Errors per store and type among each store's latest ``cap`` errors;
    ``cap=None`` counts every error of the window."""
    return _error_summary(errors, as_of, days, cap, store_id, "ErrorTypeUDC", "ErrorType")


def error_source_summary(
    errors: DataFrame, as_of: Clock, days: int = 3, cap: int | None = 50, store_id=None
) -> DataFrame:
    """The same by source."""
    return _error_summary(errors, as_of, days, cap, store_id, "ErrorSource", "ErrorSource")


@dataclass(frozen=True)
class IgnoreRule:
    """An error that may be ignored: a substring, or a regular expression."""

    pattern: str
    description: str
    enabled: bool = True
    is_regex: bool = False


# The error rules that ship with the configuration.
DEFAULT_RULES = (
    IgnoreRule(
        "SQLite error no such table: Department_POS",
        "Department_POS table is not used in current implementation",
    ),
    IgnoreRule(
        "no such table: Department_POS", "Alternative pattern for Department_POS table error"
    ),
    IgnoreRule("Bulk Copy Failed", "Alternative pattern for Bulk Copy Failed"),
    IgnoreRule(
        "^.*no such table: Department_.*$",
        "Ignore all Department-related table errors",
        enabled=False,
        is_regex=True,
    ),
)


def usable_regex(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark accepts the pattern. Tried on an empty text; reads no table. A pattern
    that does not compile is warned about; any other failure is raised."""
    try:
        spark.sql("SELECT rlike('', :pattern)", args={"pattern": pattern}).collect()
    except PySparkException as failure:
        if not (failure.getCondition() or "").startswith("INVALID_PARAMETER_VALUE"):
            raise
        warnings.warn(f"ignore rule left out, its pattern does not compile: {pattern}", stacklevel=2)
        return False
    return True


def _rule_tests(
    spark: SparkSession,
    message: Column,
    rules: Sequence[IgnoreRule],
    case_sensitive: bool,
    use_regex: bool,
) -> list[tuple[Column, str]]:
    """Condition and description of each usable rule, substrings before patterns."""
    tests = []
    for rule in rules:
        if rule.enabled and not rule.is_regex:
            if case_sensitive:
                hit = F.contains(message, F.lit(rule.pattern))
            else:
                hit = F.contains(F.lower(message), F.lit(rule.pattern.lower()))
            tests.append((hit, rule.description))
    for rule in rules:
        if use_regex and rule.enabled and rule.is_regex:
            pattern = rule.pattern if case_sensitive else f"(?i){rule.pattern}"
            if usable_regex(spark, pattern):
                tests.append((message.rlike(pattern), rule.description))
    return tests


def flag_ignored_errors(
    errors: DataFrame,
    rules: Sequence[IgnoreRule] = DEFAULT_RULES,
    case_sensitive: bool = False,
    use_regex: bool = True,
) -> DataFrame:
    """Error rows with a flag and the description of the first rule that matches.

    The rules fold into one conditional expression, so the log is read once and
    nothing is shuffled. Rules with a pattern Spark rejects are left out.
    """
    message = F.col("ErrorMessage")
    tests = _rule_tests(errors.sparkSession, message, rules, case_sensitive, use_regex)
    reason = F.lit(None).cast("string")
    for hit, description in reversed(tests):
        reason = F.when(hit, description).otherwise(reason)
    return errors.withColumn("IgnoreReason", reason).withColumn(
        "IsIgnored", F.col("IgnoreReason").isNotNull().cast("int")
    )
