"""Top-k and latest-row building blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.export import stored

# Orders rows that share a dispense date. Rows that agree in all of these are equal
# in every report, so which of them is taken makes no difference.
DISPENSE_TIES = ("ScriptNo", "DrugVal", "RepeatNo", "TotalRepeats", "BrandName")


def newest_first(date_column: str, ties: tuple[str, ...]) -> list[Column]:
    return [F.col(name).desc_nulls_last() for name in (date_column, *ties)]


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group.

    Written as ``row_number() <= n`` so that Spark puts a group limit in front of
    the shuffle: each task sends at most ``n`` rows per group, however large the
    group is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def top_rows(df: DataFrame, n: int, order: list[Column], per: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows overall, or per group when ``per`` is given. Callers
    pass an order that leaves no ties."""
    if per:
        return first_per_group(df, per, order, n).orderBy(*per, *order)
    return df.orderBy(*order).limit(n)


# Copies of a row beyond this many are written out by several tasks.
CHUNK = 100_000


def running_sums(
    df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """``df`` with running sums inside its groups, for groups of any size.

    Rows must differ in ``group`` and ``order``; ``group`` must not be null, nulls come
    first in ``order``. Each sum runs up to and includes its row.

    The rows are sorted into ranges by group and order and stored, so that a range is the
    same whenever it is read again. A sum inside a range needs only that range's part of
    a group. A group that goes on from earlier ranges is the last one in each of them and
    the first one here: what those ranges hold of it is summed by range, one row each, and
    added. No task sees more than one range of a group.
    """
    by = [*group, *(F.col(name).asc_nulls_first() for name in order)]
    ranges = stored(
        df.withColumns({f"_add_{name}": value for name, value in sums.items()})
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_range", F.spark_partition_id())
    )
    keyed = ranges.withColumn("_group", F.struct(*group))
    ends = keyed.groupBy("_range").agg(
        F.min("_group").alias("_first"), F.max("_group").alias("_last")
    )
    adds = {name: F.col(f"_add_{name}") for name in sums}
    tails = (
        keyed.join(F.broadcast(ends.select("_range", F.col("_last").alias("_group"))), ["_range", "_group"])
        .groupBy("_group", "_range")
        .agg(*(F.sum(add).alias(name) for name, add in adds.items()))
    )
    starts = ends.select(F.col("_first").alias("_group"), "_range")
    both = tails.withColumn("_asks", F.lit(False)).unionByName(
        starts.withColumn("_asks", F.lit(True)), allowMissingColumns=True
    )
    earlier = Window.partitionBy("_group").orderBy("_range").rangeBetween(Window.unboundedPreceding, -1)
    offsets = (
        both.select("_group", "_range", "_asks", *(F.sum(n).over(earlier).alias(f"_off_{n}") for n in sums))
        .where(" OR ".join(f"_off_{n} IS NOT NULL" for n in sums))
        .where("_asks")
        .select(F.struct("_range", "_group").alias("_key"), *(f"_off_{n}" for n in sums))
    )
    inside = (
        Window.partitionBy("_range", *group)
        .orderBy(*by[len(group) :])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranges.withColumns({n: F.sum(add).over(inside) for n, add in adds.items()})
    placed = placed.withColumn("_key", F.struct("_range", F.struct(*group).alias("_group")))
    whole = {n: F.col(n) + F.coalesce(F.col(f"_off_{n}"), F.lit(0)) for n in sums}
    return placed.join(offsets, "_key", "left").select(
        *df.columns, *(total.alias(n) for n, total in whole.items())
    )


def dense_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with the numbers 1, 2, ... of its rows in this order, nulls first.

    Rows must differ in ``order``. Two passes: the rows are sorted into ranges, stored and
    counted by range, then every range numbers its own rows after the sum of the counts
    before it. Only those sums, one row a range, meet in one task and are broadcast. The
    order fixes the numbers, so a task that is run again gives the same ones.
    """
    by = [F.col(column).asc_nulls_first() for column in order]
    ranges = stored(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = before.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    numbered = ranges.withColumn("_place", place).join(F.broadcast(before), "_range")
    return numbered.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))


def number_rows(
    df: DataFrame, group: list[str], order: list[str], copies: str | None = None
) -> DataFrame:
    """1-based position of every row in its group, for groups of any size.

    ``df`` is cut down to ``group`` and ``order`` columns; ``group`` columns must not be
    null. Rows that agree in all columns are counted first and told apart by a number, so
    that many copies of one row are spread as well, and so that a recomputed task gives
    the same positions. ``copies`` names a column of numbers if they are counted already.
    """
    how_many = F.count("*") if copies is None else F.sum(copies)
    counted = df.groupBy(*group, *order).agg(how_many.alias("_n"))
    few = counted.where(F.col("_n") <= CHUNK).select(
        *group, *order, F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_copy")
    )
    runs = F.explode(F.sequence(F.lit(1).cast("long"), "_n", F.lit(CHUNK).cast("long")))
    many = counted.where(F.col("_n") > CHUNK).withColumn("_run", runs)
    last = F.least(F.col("_n"), F.col("_run") + CHUNK - 1)
    many = many.repartition(*group, *order, "_run").select(
        *group, *order, F.explode(F.sequence("_run", last)).alias("_copy")
    )
    one = {"_position": F.lit(1).cast("long")}
    return running_sums(few.union(many), group, [*order, "_copy"], one).drop("_copy")
