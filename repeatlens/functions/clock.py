"""Time arithmetic around an explicit clock.

``as_of`` replaces "now" in every report. It is a naive wall-clock time, so the
window edges are computed here in Python and reach Spark as literals, which lets
range predicates go down to the parquet scan.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

Clock = datetime | str


def to_clock(as_of: Clock) -> datetime:
    """A naive ``datetime`` from a datetime or ISO text."""
    moment = datetime.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    if moment.tzinfo is not None:
        raise ValueError("as_of must be a naive wall-clock time")
    return moment


def shifted(as_of: Clock, days: int) -> datetime:
    """The clock moved by whole days, keeping the time of day."""
    return to_clock(as_of) + timedelta(days=days)


def day_start(as_of: Clock, days: int = 0) -> datetime:
    """Midnight of the clock's day, moved by whole days."""
    return datetime.combine(to_clock(as_of).date(), time.min) + timedelta(days=days)


def moment(value: Clock) -> Column:
    """A timestamp-without-time-zone literal."""
    return F.lit(to_clock(value).isoformat(sep=" ")).cast("timestamp_ntz")


def since(ts: Column, as_of: Clock, days: int) -> Column:
    """Rows from the last ``days`` days, time of day included."""
    return ts >= moment(shifted(as_of, -int(days)))


def on_day_of(ts: Column, as_of: Clock) -> Column:
    """Same calendar day as the clock, written as a half-open range on the raw
    column so that it can prune row groups."""
    return (ts >= moment(day_start(as_of))) & (ts < moment(day_start(as_of, 1)))


def plus_days(ts: Column, days: int) -> Column:
    """Add whole days and keep the time of day."""
    return ts + F.make_dt_interval(days=F.lit(int(days)))


def days_between(start: Column, end: Column) -> Column:
    """Midnights crossed going from ``start`` to ``end``."""
    return F.datediff(end, start)


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end``, rounded down also below zero. Stays on
    wall-clock times, so a clock change of the session's zone has no effect."""
    cut = (end - start).cast("interval minute").cast("long")
    return F.when(end < start + F.make_dt_interval(mins=cut.cast("int")), cut - 1).otherwise(cut)


def date_text(ts: Column) -> Column:
    """``yyyy-MM-dd``."""
    return F.to_date(ts).cast("string")


def time_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, fractions cut off."""
    return F.substring(ts.cast("string"), 1, 19)
