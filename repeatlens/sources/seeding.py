"""Tables that grow by batches, each added once however often it is sent."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.filters import not_exists_insert


class SeededTable:
    """A table in a folder that all executors share, made of named batches.

    A batch is first written to a folder of its own, ``rows/<batch>``, and then marked in
    ``marks/<batch>``; readers see the rows of marked batches only. Spark publishes the files
    of a write when its last task is done, so a job or a driver that is lost half way leaves
    either no mark, and the batch is written anew when it is sent again, or the whole batch.
    One writer at a time: two that seed at once could both find a row absent.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str]):
        self._spark, self._folder, self._schema, self._keys = spark, folder.rstrip("/"), schema, keys

    def batches(self) -> list[str]:
        """The names of the batches that are in the table."""
        try:
            marks = self._spark.read.schema("batch STRING").parquet(f"{self._folder}/marks/*")
            return sorted(row["batch"] for row in marks.distinct().collect())
        except AnalysisException as failure:
            if failure.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def read(self) -> DataFrame:
        """The rows of all batches."""
        paths = [f"{self._folder}/rows/{name}" for name in self.batches()]
        if not paths:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*paths)

    def seed(self, batch: str, rows: DataFrame) -> bool:
        """Add those rows whose key the table does not have yet; False if the batch was
        added before.

        Rows without a key count as new. A key that the batch itself repeats adds all its
        rows. Columns that the table does not have are left out.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_-]*", batch):
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
        if batch in self.batches():
            return False
        fitted = rows.select(
            *(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self._schema)
        )
        absent = not_exists_insert(fitted, self.read(), self._keys)
        absent.write.mode("overwrite").parquet(f"{self._folder}/rows/{batch}")
        self._mark(batch)
        return True

    def _mark(self, batch: str) -> None:
        mark = self._spark.range(1).select(F.lit(batch).alias("batch"))
        mark.write.mode("overwrite").parquet(f"{self._folder}/marks/{batch}")
