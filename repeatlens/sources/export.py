"""Files written for people, and the folder jobs may share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.clock import Clock, to_clock
from ..functions.text import file_slug
from ..functions.values import blank_zero

# The column heads of the refill file and the columns below them.
REFILL_CSV_COLUMNS = {
    "Patient ID": "PatientId",
    "Medication": "Drugname",
    "Brand": "BrandName",
    "Last Dispense": "LastDispenseDate",
    "Predicted Refill": "PredictedRefillDate",
    "Days Until Due": "DaysUntilDue",
    "Repeats Remaining": "RepeatsRemaining",
    "Total Repeats": "TotalRepeats",
    "Contact Email": "ContactEmail",
    "Urgency": "Urgency",
}
_NUMBERS = ("DaysUntilDue", "RepeatsRemaining", "TotalRepeats")


def refill_csv_rows(refills: DataFrame, with_store: bool = False) -> DataFrame:
    """The refill list under its file heads; a zero becomes an empty cell."""
    cells = [
        (blank_zero(F.col(name)) if name in _NUMBERS else F.col(name)).alias(head)
        for head, name in REFILL_CSV_COLUMNS.items()
    ]
    return refills.select(*(["StoreId"] if with_store else []), *cells)


def export_refills_csv(refills: DataFrame, path: str, per_store: bool = False) -> str:
    """Write the refill list as CSV with a header and return the path.

    One folder per store with ``per_store``; then rows are dealt by ranges of store and
    order, so a store is in few files and a large one is written by several tasks. Quotes
    inside text are doubled.
    """
    if per_store:
        by = ["StoreId", "PredictedRefillDate", "PatientId", "Drugname"]
        refills = refills.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = refill_csv_rows(refills, per_store)
    writer = rows.write.mode("overwrite").option("header", True).option("escape", '"')
    if per_store:
        writer = writer.partitionBy("StoreId")
    writer.csv(path)
    return path


def read_refills_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exported list as text columns, empty cells as null."""
    schema = StructType([StructField(head, StringType()) for head in REFILL_CSV_COLUMNS])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def refill_file_name(store_name: str, as_of: Clock) -> str:
    """Name of a store's refill file."""
    return f"refill-predictions-{file_slug(store_name)}-{to_clock(as_of).date().isoformat()}.csv"


def save_table(df: DataFrame, path: str, sort_by: list[str] | None = None) -> DataFrame:
    """Write a built table as parquet, replacing the old one, and read it back.

    ``sort_by`` lays the rows out in ranges of those columns, so that filters on
    the first of them skip files and row groups by their bounds. Name enough
    columns to tell rows apart; a single hot value could not be split otherwise.
    """
    laid_out = df
    if sort_by:
        laid_out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
    laid_out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    A local session may do without, then a temporary folder is set. On a cluster a folder of
    the driver's own would be out of the executors' reach, so there it has to be named.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="repeatlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the one all executors share."""
    return f"{shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, with their lineage cut: reading them again
    gives the same rows in the same partitions, whatever executors are lost."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
