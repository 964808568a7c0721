"""The domain tables as projections of the generic test tables.

Every projection reads its source tables whole. Orders play scripts (one order =
one script, drug and store), line items their dispenses, customers the patients
and users, suppliers the stores, events the error log and the heartbeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.access import role_permission_matrix
from ..operators.refills import build_patient_contacts
from .tables import Tables

# The clock of the dispense reports, and of the error and heartbeat reports.
DISPENSE_CLOCK = "2001-07-31 10:30:00"
EVENT_CLOCK = "2024-01-31 00:00:00"

# Declared, so that opening a table needs no job to read file footers.
TEST_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
        props STRING""",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

# Line items a task joins on average; Spark's own tasks hold what fits in 64 MB compressed. And the
# most tasks: shuffles into more (spark.shuffle.sort.bypassMergeThreshold) gather rows in memory.
TASK_LINES, MOST_TASKS = 1_000_000, 200

# The roles, by id from 1.
ROLES = (
    ("Super Admin", "Full system access with all permissions"),
    ("Pharmacy Manager", "Manage pharmacy operations and view reports"),
    ("Data Analyst", "Access to analytics and reporting features"),
    ("Support Staff", "Basic access with support chat capabilities"),
    ("Viewer", "Read-only access to dashboard and basic features"),
)

# The permissions, by id from 1.
PERMISSIONS = (
    ("VIEW_DASHBOARD", "Access to main dashboard", "Dashboard"),
    ("VIEW_PHARMACIES", "View pharmacy information", "Pharmacies"),
    ("EDIT_PHARMACIES", "Edit pharmacy information", "Pharmacies"),
    ("VIEW_ANALYTICS", "Access analytics and reports", "Analytics"),
    ("VIEW_PATIENT_ADHERENCE", "View patient adherence data", "Patient Care"),
    ("VIEW_REFILL_PREDICTIONS", "View refill predictions", "Patient Care"),
    ("USE_SUPPORT_CHAT", "Access support chat assistant", "Support"),
    ("MANAGE_USERS", "Create, edit, disable users", "User Management"),
    ("MANAGE_ROLES", "Create and manage user roles", "User Management"),
    ("SYSTEM_ADMIN", "Full system administration access", "Administration"),
    ("VIEW_REPORTS", "Access to all reporting features", "Reports"),
    ("EXPORT_DATA", "Export data to various formats", "Data"),
    ("VIEW_BIR_MONITORING", "Access BIR integration monitoring", "Integration"),
)


def sample_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All domain tables over the test tables in ``sf_dir``."""
    loaders = {
        "dispense": dispense,
        "stores": stores,
        "patients": patients,
        "contacts": contacts,
        "sales": sales,
        "stock": stock,
        "ean_links": ean_links,
        "wh_patients": wh_patients,
        "dispense_transactions": dispense_transactions,
        "errors": errors,
        "pings": pings,
        "users": users,
        "roles": roles,
        "permissions": permissions,
        "role_permissions": role_permissions,
        "messages": messages,
    }
    source = _Source(spark, sf_dir)
    return Tables({name: _bind(build, source) for name, build in loaders.items()})


def _bind(build, source):
    return lambda: build(source)


class _Source:
    """The test tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def __call__(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(TEST_SCHEMAS[name])
        return reader.parquet(f"{self._dir}/{name}.parquet")


def dispense(source) -> DataFrame:
    """All line items of an order. Part keys count from 0, and the order's key picks the
    drug: one order is one script with one drug."""
    lines, parts = source("lineitem"), source("part")
    count = F.nullif(parts.select(F.count(F.lit(1))).scalar(), F.lit(0))
    orders = source("orders").withColumn("_drug", F.col("o_orderkey") % count)
    # Tasks of a long table are dealt by its length, so that what one sorts, and its caller counts
    # beside that, stays small. Fewer of them than cores are left to Spark.
    tasks = min(-(-lines.count() // TASK_LINES), MOST_TASKS)
    if tasks > source.spark.sparkContext.defaultParallelism:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
        parts = parts.repartition(tasks, "p_partkey")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    joined = sold.join(parts, F.col("_drug") == F.col("p_partkey"))
    return joined.selectExpr(
        "CASE WHEN o_custkey % 97 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS PatPharmSysID",
        "CAST(o_orderkey AS STRING) AS OriginalScriptNumber",
        "o_orderkey * 10 + l_linenumber AS ScriptNo",
        "CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE p_name END AS Drugname",
        "p_brand AS BrandName",
        "CASE p_type WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN '' ELSE p_type END AS DrugSchedule",
        "CAST(o_custkey % 10 AS INT) AS StoreId",
        "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 6 AS INT) END"
        " AS TotalRepeats",
        "CAST(l_linenumber - 1 AS INT) AS RepeatNo",
        "l_shipdate AS DispensedDate",
        "o_orderdate AS DatePrescribed",
        "CAST(l_extendedprice AS STRING) AS DrugVal",
        "p_retailprice AS PatientPrice",
    )


def stores(source) -> DataFrame:
    """Stores 0 to 9 dispense. Store 9 is listed under another id, so its
    dispenses have no store row; all further stores have no dispenses."""
    nation = source("nation").select("n_nationkey", "n_name")
    named = source("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.selectExpr(
        "CAST(CASE WHEN s_suppkey = 9 THEN -9 ELSE s_suppkey END AS INT) AS PharmacyID",
        "CASE WHEN s_suppkey % 3 = 0 THEN concat('CHEMIST Discount Centre ', n_name)"
        " ELSE s_name END AS CommercialName",
        "n_name AS TimeZoneState",
        "CASE WHEN s_suppkey % 4 = 1 THEN 1 WHEN s_suppkey % 4 = 2 THEN NULL ELSE 0 END"
        " AS ExcludeHC",
        "CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE 1 END AS BIRExtractionFlag",
        "s_name AS ContactPerson1",
        "CAST(NULL AS STRING) AS ContactPerson2",
        "CAST(NULL AS STRING) AS ContactNumber",
        "CAST(NULL AS STRING) AS PharmacyGroupId",
        "CAST(NULL AS STRING) AS CommentsHC",
        "CAST(NULL AS STRING) AS BestContactTime",
        "CAST(NULL AS TIMESTAMP_NTZ) AS UpdatedDate",
        "1 AS IsActive",
    )


def patients(source) -> DataFrame:
    return source("customer").selectExpr(
        "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) END AS dispenseid",
        "c_custkey % 10 AS storeid",
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Female' WHEN 'MACHINERY' THEN 'male'"
        " WHEN 'FURNITURE' THEN 'MALE' WHEN 'BUILDING' THEN NULL ELSE 'Unknown' END AS gender",
    )


def contacts(source) -> DataFrame:
    return build_patient_contacts(patients(source), DISPENSE_CLOCK)


def sales(source) -> DataFrame:
    return source("orders").selectExpr(
        "CAST(o_custkey % 10 AS STRING) AS StoreId", "o_orderdate AS SalesDate"
    )


def stock(source) -> DataFrame:
    """One stock row per store and item."""
    return (
        source("lineitem")
        .selectExpr("CAST(l_suppkey % 10 AS STRING) AS StoreId", "l_partkey AS StockID")
        .distinct()
    )


def ean_links(source) -> DataFrame:
    return source("lineitem").selectExpr(
        "CAST(l_suppkey % 10 AS STRING) AS StoreId", "l_partkey AS EAN"
    )


def wh_patients(source) -> DataFrame:
    """Store 4 does not fill in the store column, so it has no count here."""
    return source("customer").selectExpr(
        "CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE CAST(c_custkey % 10 AS STRING) END AS StoreId",
        "c_custkey AS PatientId",
    )


def dispense_transactions(source) -> DataFrame:
    """The dispenses as the warehouse holds them: fewer columns, store ids as text."""
    return dispense(source).selectExpr(
        "CAST(StoreId AS STRING) AS StoreId", "PatPharmSysID", "DispensedDate", "ScriptNo", "Drugname"
    )


def errors(source) -> DataFrame:
    return source("events").selectExpr(
        "CAST(user_id % 10 AS STRING) AS PharmacyId",
        "event_id AS ErrorID",
        "CASE WHEN event_type = 'error' THEN 'E' ELSE 'W' END AS ErrorIndicator",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS ErrorTypeUDC",
        "CASE event_id % 3 WHEN 0 THEN 'BIR' WHEN 1 THEN 'SYNC' END AS ErrorSource",
        "CASE event_id % 5 WHEN 0 THEN 'SQLite error no such table: Department_POS'"
        " WHEN 1 THEN concat('bulk copy failed for batch ', CAST(event_id AS STRING))"
        " WHEN 2 THEN concat('no such table: Department_X ', props)"
        " WHEN 4 THEN concat('Timeout while reading from the store gateway, retry scheduled"
        " after ', props, ' attempts') END AS ErrorMessage",
        "CAST(NULL AS STRING) AS StepUDC",
        "event_type AS TableName",
        "ts AS ErrorDate",
    )


def pings(source) -> DataFrame:
    """Every event is a ping; the store's number delays it by tens of minutes.
    Events of store 2 carry no store, so it has no pings."""
    return source("events").selectExpr(
        "CASE WHEN user_id % 10 = 2 THEN NULL ELSE CAST(user_id % 10 AS INT) END AS StoreId",
        "ts - INTERVAL '10' MINUTE * CAST(user_id % 10 AS INT) AS ping",
    )


def users(source) -> DataFrame:
    """Role 6 does not exist: those users have none."""
    return source("customer").selectExpr(
        "c_custkey AS Userid",
        "c_name AS Username",
        "concat('user', CAST(c_custkey AS STRING), '@example.com') AS Email",
        "c_mktsegment AS Firstname",
        "concat('Family', CAST(c_custkey AS STRING)) AS Lastname",
        "CASE WHEN c_custkey % 5 = 0 THEN 'Inactive' ELSE 'Active' END AS Status",
        "CASE WHEN c_custkey % 5 = 0 THEN 'SUS20' ELSE 'SUS10' END AS StatusUDC",
        "CASE WHEN c_custkey % 6 = 0 THEN 1 ELSE 0 END AS IsSuperAdmin",
        "CAST(1 + c_custkey % 6 AS INT) AS RoleID",
        "TIMESTAMP_NTZ '2024-01-01 08:00:00' + INTERVAL '1' DAY * CAST(c_custkey % 365 AS INT)"
        " AS CreatedDate",
        "CAST(NULL AS TIMESTAMP_NTZ) AS UpdatedDate",
    )


def roles(source) -> DataFrame:
    """The roles that users refer to."""
    named = source.spark.createDataFrame(
        [(place, *role) for place, role in enumerate(ROLES, 1)],
        "RoleID INT, RoleName STRING, RoleDescription STRING",
    )
    used = users(source).select("RoleID").distinct()
    return used.join(named, "RoleID").withColumn("IsActive", F.lit(1))


def permissions(source) -> DataFrame:
    """The permissions that items of the part table refer to."""
    named = source.spark.createDataFrame(
        [(place, *row) for place, row in enumerate(PERMISSIONS, 1)],
        "PermissionID INT, PermissionName STRING, PermissionDescription STRING, Module STRING",
    )
    used = (
        source("part")
        .select(F.expr(f"CAST(1 + p_partkey % {len(PERMISSIONS)} AS INT)").alias("PermissionID"))
        .distinct()
    )
    return used.join(named, "PermissionID").withColumn("IsActive", F.lit(1))


def role_permissions(source) -> DataFrame:
    return (
        role_permission_matrix(roles(source), permissions(source))
        .select("RoleID", "PermissionID")
        .withColumn("IsActive", F.lit(1))
    )


def messages(source) -> DataFrame:
    """Every turn of a conversation is a message: one of twelve phrasings, or the turn's own text."""
    return source("conversations").selectExpr(
        "conv_id",
        "turn",
        "CASE (conv_id * 3 + turn) % 13"
        " WHEN 0 THEN concat('Info ', CAST(conv_id AS STRING))"
        " WHEN 1 THEN concat('BIR ', CAST(conv_id AS STRING))"
        " WHEN 2 THEN concat('error ', CAST(conv_id AS STRING))"
        " WHEN 3 THEN concat('Show pharmacy ', CAST(conv_id AS STRING))"
        " WHEN 4 THEN 'pharmacy status'"
        " WHEN 5 THEN 'patient medication history'"
        " WHEN 6 THEN 'dispensing stats'"
        " WHEN 7 THEN 'recent prescriptions'"
        " WHEN 8 THEN concat('Last sale for store ', CAST(conv_id AS STRING))"
        " WHEN 9 THEN 'last dispense'"
        " WHEN 10 THEN concat('How many barcodes in ', CAST(conv_id AS STRING))"
        " WHEN 11 THEN 'help me'"
        " ELSE text END AS message",
    )
