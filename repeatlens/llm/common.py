"""What several operators share: column choice, folds, checkpoints, the tables' paths."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.sources.export import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (long) and ``text``, whatever other columns there are; null text as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder (``spark.checkpoint.dir``), with their lineage cut."""
    return stored(df)


_SHIPPED: set[str] = set()


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for functions of this package, whose code Spark sends to the executors."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="code-"), os.path.basename(package))
        root, name = os.path.split(package)
        sc.addPyFile(shutil.make_archive(target, "zip", root, name))
        _SHIPPED.add(sc.applicationId)
    return df.mapInArrow(run, schema)
