"""Row filters shared by the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import Clock, on_day_of, since
from ..functions.text import like_pattern


def same_as(df: DataFrame, column: str, value) -> Column:
    """Equality with a parameter, cast to the column's own type so that the
    comparison stays on the bare column and can be pushed to the scan."""
    return F.col(column) == F.lit(value).cast(df.schema[column].dataType)


def for_store(df: DataFrame, store_id=None, column: str = "StoreId") -> DataFrame:
    """One store's rows, or all rows without a store."""
    return df if store_id is None else df.where(same_as(df, column, store_id))


def recent_window(df: DataFrame, ts: str, as_of: Clock, days: int | None) -> DataFrame:
    """Rows from the last ``days`` days; all rows without a number of days."""
    return df if days is None else df.where(since(F.col(ts), as_of, days))


def same_day(df: DataFrame, ts: str, as_of: Clock) -> DataFrame:
    return df.where(on_day_of(F.col(ts), as_of))


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the named columns have a value."""
    tests = [F.col(name).isNotNull() for name in columns]
    return df.where(reduce(lambda left, right: left & right, tests)) if tests else df


def dispense_filter(
    dispense: DataFrame,
    as_of: Clock,
    days: int | None = None,
    store_id=None,
    schedule: str | None = None,
    drug: str | None = None,
    min_repeats: int | None = None,
) -> DataFrame:
    """The optional filters of the dispense reports, joined by AND."""
    df = for_store(recent_window(dispense, "DispensedDate", as_of, days), store_id)
    if schedule:
        df = df.where(F.col("DrugSchedule") == schedule)
    if drug:
        df = df.where(F.col("Drugname").ilike(like_pattern(drug)))
    if min_repeats is not None:
        df = df.where(F.col("TotalRepeats") >= int(min_repeats))
    return df


def matched(df: DataFrame, unique: DataFrame, on: list[str], how: str) -> DataFrame:
    """Equality join of ``df`` to rows that are unique in ``on`` and have no null
    there, safe for keys that hold a large share of ``df``.

    The keys meet as one struct. That gives the join shuffles of its own even where
    ``unique`` was just grouped by the same columns, and adaptive execution splits
    a hot partition only when the shuffle sits right below the join. Nothing is
    broadcast by force: a small side is broadcast once its size is known.
    """
    key = F.struct(*[F.col(name) for name in on])
    left = df.withColumn("_key", key)
    right = unique.withColumn("_key", key).drop(*on)
    return left.join(right, "_key", how).drop("_key")


def _key_set(df: DataFrame, on: list[str]) -> DataFrame:
    """The key values that occur, each once. Combined before the shuffle, so a hot
    key travels once per task."""
    return present(df.select(*on), *on).distinct()


def lookup_by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in the key table. A repeated key does not repeat rows."""
    return matched(df, _key_set(keys, on), on, "left_semi")


def not_exists_insert(new: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """The new rows whose key is not in the existing table yet. A row without a
    key counts as new."""
    return matched(new, _key_set(existing, on), on, "left_anti")
