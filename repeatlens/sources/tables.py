"""Named tables, loaded on first use."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .export import stored
from .schemas import SCHEMAS, WAREHOUSE_TABLES, conform

Loader = Callable[[], DataFrame]
Reader = Callable[[str, str], DataFrame]


class Tables:
    """Tables by name, as attributes. A table is opened when it is first asked
    for, so a report touches only the tables it reads."""

    def __init__(self, loaders: Mapping[str, Loader]):
        self._loaders = dict(loaders)
        self._opened: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._loaders:
            raise AttributeError(name)
        if name not in self._opened:
            self._opened[name] = self._loaders[name]()
        return self._opened[name]

    def names(self) -> list[str]:
        return list(self._loaders)

    def as_dict(self, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in (names or self.names())}

    def register(self, names: Iterable[str] | None = None) -> None:
        """Make the tables visible to SQL under their names."""
        for name, df in self.as_dict(names).items():
            df.createOrReplaceTempView(name)


def load_tables(
    spark: SparkSession,
    base: str,
    warehouse: str | None = None,
    reader: Reader | None = None,
) -> Tables:
    """Tables of both databases, checked against the declared schemas.

    By default ``<folder>/<name>.parquet`` is read, the warehouse tables from
    their own folder when one is given. ``reader(folder, name)`` replaces that
    for other formats, or for a database with :func:`jdbc_reader`.
    """

    def read_parquet(folder: str, name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    read = reader or read_parquet

    def loader(name: str) -> Loader:
        folder = (warehouse or base) if name in WAREHOUSE_TABLES else base
        return lambda: conform(read(folder, name), SCHEMAS[name], name)

    return Tables({name: loader(name) for name in SCHEMAS})


def first_that_runs(spark: SparkSession, sources: Mapping[str, Loader]) -> DataFrame:
    """The result of the first source that can be computed as a whole, with the columns
    ``Source``, its name, and ``Reason``: why each earlier one failed (null if none did).

    A file may turn out to be broken in the middle of a job, so a look at the schema proves
    nothing: each result is computed and stored before it counts. Meant for grouped results.
    Only failures of Spark's own count (a missing or unreadable source, a column that is not
    there); if all sources fail, the last failure is raised. The results must have the same
    columns.
    """
    reasons, failure = [], None
    for name, build in sources.items():
        try:
            result = stored(build())
        except (PySparkException, Py4JJavaError) as caught:
            failure = caught
            reasons.append(f"{name}: {_brief(caught)}")
            continue
        reason = F.lit("; ".join(reasons) if reasons else None).cast("string")
        return result.withColumn("Source", F.lit(name)).withColumn("Reason", reason)
    raise failure or ValueError("no source is given")


def _brief(failure: Exception) -> str:
    """The first line that tells what was wrong."""
    condition = failure.getCondition() if isinstance(failure, PySparkException) else None
    lines = str(failure).strip().splitlines()
    return condition or (lines[0] if lines else type(failure).__name__)


@dataclass(frozen=True)
class Split:
    """How a database table is read in parallel: equal ranges of a number, date or
    timestamp column, one connection each. Rows outside the bounds are read too."""

    column: str
    lower: str
    upper: str
    parts: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": self.lower,
            "upperBound": self.upper,
            "numPartitions": str(self.parts),
        }


def jdbc_reader(
    spark: SparkSession, url: str, splits: Mapping[str, Split] | None = None, **options: str
) -> Reader:
    """Reader over a JDBC connection, for :func:`load_tables`. The folder names the
    database schema; tables without a split come through one connection."""

    def read(folder: str, name: str) -> DataFrame:
        settings = {"url": url, "dbtable": f"{folder}.{name}", **options}
        if splits and name in splits:
            settings |= splits[name].options()
        return spark.read.format("jdbc").options(**settings).load()

    return read


def run_sql(spark: SparkSession, query: str, **params) -> DataFrame:
    """SQL over the registered tables with named parameters (``:name``). Values
    are bound by Spark and never become part of the query text."""
    return spark.sql(query, args=params)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once. Empty for a proper dimension table."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: list[str], name: str = "table") -> DataFrame:
    """The table itself, after a job has shown that its keys are unique."""
    repeated = repeated_keys(df, keys).limit(1).collect()
    if repeated:
        raise ValueError(f"{name} repeats the key {repeated[0].asDict()}")
    return df
