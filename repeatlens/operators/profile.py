"""Table profiling."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import present


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, nullability, nulls, distinct values, smallest and largest value of
    every column. Columns hold plain values, no arrays, maps or structs.

    Each column of a stored table is read apart, so the table is read once in all and no row
    is multiplied. A column is counted per value before the shuffle: a value that fills a
    third of it travels once per task. Nulls, bounds and the number of values come from the
    same counts. A computed table is computed once per column; store it first.
    ``approximate`` counts distinct values with a sketch, all columns in one pass with one row
    per task to shuffle.
    """
    fields = df.schema.fields
    heads = [
        F.struct(
            F.lit(place + 1).alias("position"),
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.lit("YES" if field.nullable else "NO").alias("nullable"),
        )
        for place, field in enumerate(fields)
    ]
    listed = df.sparkSession.range(1).select(F.inline(F.array(*heads)))
    return (
        listed.join(_measures(df, approximate), "position", "left")
        .select(
            *listed.columns,
            F.coalesce("null_count", F.lit(0)).alias("null_count"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            "min_value",
            "max_value",
        )
        .orderBy("position")
    )


def _measures(df: DataFrame, approximate: bool) -> DataFrame:
    """Measures of all columns, by position."""
    if approximate:
        return _sketched(df)
    each = []
    for place, name in enumerate(df.columns):
        values = df.groupBy(F.col(f"`{name}`").alias("value")).agg(F.count("*").alias("rows"))
        each.append(
            values.agg(
                F.lit(place + 1).alias("position"),
                F.sum(F.when(F.col("value").isNull(), F.col("rows"))).alias("null_count"),
                F.count("value").alias("distinct_count"),
                F.min("value").cast("string").alias("min_value"),
                F.max("value").cast("string").alias("max_value"),
            )
        )
    return reduce(DataFrame.unionByName, each)


def _sketched(df: DataFrame) -> DataFrame:
    """The same from one wide aggregate, whose only row is then split by column."""
    wide = [
        F.struct(
            F.lit(place + 1).alias("position"),
            F.count_if(column.isNull()).alias("null_count"),
            F.approx_count_distinct(column).alias("distinct_count"),
            F.min(column).cast("string").alias("min_value"),
            F.max(column).cast("string").alias("max_value"),
        )
        for place, column in enumerate(F.col(f"`{name}`") for name in df.columns)
    ]
    return df.agg(F.array(*wide).alias("measures")).select(F.inline("measures"))


def sample_rows(df: DataFrame, n: int = 3, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows; any ``n`` rows without an order."""
    return df.orderBy(*order_by).limit(n) if order_by else df.limit(n)


def date_coverage(df: DataFrame, date_column: str) -> DataFrame:
    """First and last date and the number of different ones."""
    column = F.col(date_column)
    return present(df, date_column).agg(
        F.min(column).alias("EarliestDate"),
        F.max(column).alias("LatestDate"),
        F.countDistinct(column).alias("UniqueDays"),
    )


def rows_per_key(df: DataFrame, key: str, n: int | None = 5) -> DataFrame:
    """The keys with most rows."""
    counted = present(df, key).groupBy(key).agg(F.count("*").alias("TotalDispenses"))
    ordered = counted.orderBy(F.desc("TotalDispenses"), key)
    return ordered if n is None else ordered.limit(n)


def dispenses_per_store(dispense: DataFrame, n: int | None = 5) -> DataFrame:
    """The stores with most dispenses."""
    return rows_per_key(dispense, "StoreId", n)


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Number of rows of each table."""
    counts = [
        df.agg(F.count("*").alias("total_rows")).select(
            F.lit(name).alias("table_name"), "total_rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
