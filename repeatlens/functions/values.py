"""Numbers, null handling and flag decodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType


def amount(df: DataFrame, name: str) -> Column:
    """A money column as a number: a declared decimal as it is, text and others as double."""
    declared = isinstance(df.schema[name].dataType, DecimalType)
    return F.col(name) if declared else F.col(name).cast("double")


def total_amount(df: DataFrame, name: str) -> Column:
    """Sum of a money column as double. Decimals are summed exactly; doubles in the order in
    which tasks finish, so that the last digits of a total may differ between runs."""
    return F.sum(amount(df, name)).cast("double")


def mean_amount(df: DataFrame, name: str) -> Column:
    """Average of a money column as double; null when there is no value."""
    return total_amount(df, name) / F.nullif(F.count(F.col(name)), F.lit(0))


def whole_average(value: Column) -> Column:
    """Average of an integer expression cut toward zero, as integer columns
    average in the source database. Null when there is no value."""
    return F.call_function("div", F.sum(value), F.nullif(F.count(value), F.lit(0))).cast("int")


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def blank_zero(value: Column) -> Column:
    """Zero becomes null, which a CSV writer shows as an empty cell."""
    return F.nullif(value, F.lit(0))


def or_label(value: Column, label: str) -> Column:
    """``label`` where the text is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(label))


def active_flag(excluded: Column) -> Column:
    """1 unless the exclusion flag is set. An unknown flag counts as active."""
    return F.when(excluded == 1, 0).otherwise(1)


def active_text(excluded: Column, legacy: bool = False) -> Column:
    """Active / Inactive from the exclusion flag.

    The legacy lookup asks for a flag that is known to be off, so there an
    unknown flag counts as inactive.
    """
    if legacy:
        return F.when(excluded == 0, "Active").otherwise("Inactive")
    return F.when(excluded == 1, "Inactive").otherwise("Active")


def integration_text(flag: Column) -> Column:
    """Active only where the integration flag is set."""
    return F.when(flag == 1, "Active").otherwise("Inactive")
