"""Column helpers at their edges."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from repeatlens.functions import clock, text, values
from tests.frames import CLOCK


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_days_count_midnights_and_plus_days_keeps_time(spark):
    late, early = clock.moment("2024-03-14 23:59:00"), clock.moment("2024-03-15 00:01:00")
    got = one(spark, d=clock.days_between(late, early), back=clock.days_between(early, late),
              p=clock.plus_days(late, 30))
    assert got == {"d": 1, "back": -1, "p": datetime(2024, 4, 13, 23, 59)}


@pytest.mark.parametrize(
    "start, minutes",
    [
        ("2024-03-15 10:00:00", 30),
        ("2024-03-15 09:59:59", 30),
        ("2024-03-15 09:59:00", 31),
        ("2024-03-15 10:30:00", 0),
        ("2024-03-15 10:30:01", -1),
        ("2024-03-15 10:31:00", -1),
        ("2024-03-15 10:31:00.000001", -2),
        ("2023-03-15 10:30:00", 366 * 1440),
    ],
)
def test_whole_minutes_rounds_down(spark, start, minutes):
    got = one(spark, m=clock.whole_minutes(clock.moment(start), clock.moment(CLOCK)))
    assert got["m"] == minutes


def test_times_do_not_depend_on_the_session_zone(spark):
    # 02:30 does not exist in this zone on that day.
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        gap, later = clock.moment("2024-03-10 02:30:00"), clock.moment("2024-03-10 03:30:00")
        got = one(spark, t=clock.time_text(gap), d=clock.date_text(gap),
                  m=clock.whole_minutes(gap, later))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {"t": "2024-03-10 02:30:00", "d": "2024-03-10", "m": 60}


def test_fractions_are_cut_from_texts(spark):
    assert one(spark, t=clock.time_text(clock.moment("2024-03-10 02:30:00.987654"))) == {
        "t": "2024-03-10 02:30:00"
    }


def test_clock_must_be_naive():
    with pytest.raises(ValueError):
        clock.to_clock("2024-03-10T00:00:00+01:00")


@pytest.mark.parametrize(
    "numbers, expected",
    [([-1, -2], -1), ([1, 2], 1), ([-7, 0], -3), ([None], None), ([4, None], 4), ([], None)],
)
def test_whole_average_cuts_toward_zero(spark, numbers, expected):
    df = spark.createDataFrame([(n,) for n in numbers], "n INT")
    assert df.agg(values.whole_average(F.col("n"))).first()[0] == expected


def test_amounts(spark):
    df = spark.createDataFrame([("0.10",)] * 10 + [(None,)], "v STRING")
    got = df.agg(values.total_amount(df, "v"), values.mean_amount(df, "v")).first()
    assert tuple(got) == pytest.approx((1.0, 0.1))
    empty = df.where("false").agg(values.total_amount(df, "v"), values.mean_amount(df, "v"))
    assert tuple(empty.first()) == (None, None)


@pytest.mark.parametrize(
    "rows, kind, total",
    [
        (["0.00004"] * 3, "STRING", 0.00012),
        (["123456789012345678.0"], "STRING", 123456789012345678.0),
        ([0.00004] * 3, "DOUBLE", 0.00012),
        ([Decimal("0.000040")] * 3, "DECIMAL(20,6)", 0.00012),
    ],
)
def test_amounts_keep_their_digits(spark, rows, kind, total):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    assert df.agg(values.total_amount(df, "v")).first()[0] == pytest.approx(total, rel=1e-12)


def test_malformed_amount_fails(spark):
    df = spark.createDataFrame([("ten",)], "v STRING")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.agg(values.total_amount(df, "v")).collect()


def test_flags(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "f INT")
    f = F.col("f")
    got = df.select(
        values.active_flag(f), values.active_text(f), values.active_text(f, legacy=True),
        values.integration_text(f),
    ).collect()
    assert [tuple(r) for r in got] == [
        (0, "Inactive", "Inactive", "Active"),
        (1, "Active", "Active", "Inactive"),
        (1, "Active", "Inactive", "Inactive"),
    ]


def test_texts(spark):
    long = "x" * 61
    df = spark.createDataFrame([(None,), ("",), ("x" * 60,), (long,)], "t STRING")
    got = [r[0] for r in df.select(text.preview(F.col("t"))).collect()]
    assert got == ["N/A", "N/A", "x" * 60, "x" * 60 + "..."]
    name = F.lit("Chemist DISCOUNT centre North chemist discount centre")
    assert one(spark, n=text.short_brand(name)) == {"n": "CDC North CDC"}
    assert text.file_slug("St. Mary's 24/7 " + chr(0xE9)) == "St--Mary-s-24-7--"
    label = text.store_label(F.lit(None).cast("string"), F.lit(7))
    assert one(spark, n=label) == {"n": "Store 7"}
