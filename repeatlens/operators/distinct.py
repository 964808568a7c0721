"""Exact distinct counts that merge: bitmaps over dense ids.

A dictionary gives the values of a column numbers 1, 2, ... inside each group. Bitmaps of
those numbers hold 32,768 values in 4 KB, and are united by OR: counts of days, months or
stores' uploads merge without reading a row again, which counts of distinct values can not.
Numbers are dense inside a group, so a group has as few bitmaps as its values need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import matched, present
from .ranking import number_rows


def dictionary(df: DataFrame, group: str, column: str, known: DataFrame | None = None) -> DataFrame:
    """(group, column, id) for every value of a group; nulls have none.

    With a ``known`` dictionary its ids stay, and new values go on after them.
    """
    values = present(df.select(group, column), group, column).distinct()
    if known is not None:
        values = matched(values, known.select(group, column), [group, column], "left_anti")
    fresh = number_rows(values, [group], [column]).withColumnRenamed("_position", "id")
    if known is None:
        return fresh
    last = known.groupBy(group).agg(F.max("id").alias("_last"))
    fresh = matched(fresh, last, [group], "left").withColumn(
        "id", F.col("id") + F.coalesce(F.col("_last"), F.lit(0))
    )
    return known.select(group, column, "id").unionByName(fresh.select(group, column, "id"))


def bitmaps(df: DataFrame, ids: DataFrame, group: str, column: str, per: list[str] | None = None) -> DataFrame:
    """(group, *per, bucket, bits): the values of ``column`` that occur, as bitmaps.

    Pairs are made distinct in each task before they meet the dictionary, so a hot value
    travels once a task.
    """
    keys = [group, *(per or [])]
    pairs = present(df.select(*keys, column), group, column).distinct()
    return _built(matched(pairs, ids, [group, column], "inner"), keys)


def _built(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )


def counted(bits: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Distinct values by ``keys``, over all the bitmaps of them."""
    united = bits.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(name))
