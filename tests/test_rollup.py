"""Stored rollups and bitmaps against the panels that read the dispenses."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from repeatlens.operators import distinct, stores
from repeatlens.plans import reports, rollup
from repeatlens.sources.export import shared_folder
from repeatlens.sources.tables import Tables
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of

PANELS = (
    "summary", "daily_trend", "top_drugs", "schedule_mix", "store_ranking", "stores", "schedules"
)


def _tables(spark, rows):
    people = frame(spark, "patients", [])
    shops = spark.createDataFrame([(n, f"Shop {n}") for n in range(1, 4)], "PharmacyID int, CommercialName string")
    return _loaded(frame(spark, "dispense", rows), people, shops)


def _loaded(dispense, people, shops):
    return Tables({"dispense": lambda: dispense, "patients": lambda: people, "stores": lambda: shops})


def _rows(seed, n=400):
    r = random.Random(seed)
    rows = random_dispenses(n, seed=seed)
    for row in rows:  # around the clock's time of day, which cuts the days
        row["DispensedDate"] = r.choice([None, CLOCK, CLOCK, CLOCK]) and CLOCK - timedelta(
            days=r.randrange(-2, 100), seconds=r.choice([-1, 0, 0, 1, 40_000, -30_000])
        )
    return rows


def _rounded(df):
    """Rows whose sums of doubles do not hang on their order."""
    return sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.items()}) for r in rows_of(df))


def _same(got, want):
    for name in PANELS:
        assert _rounded(got[name]) == _rounded(want[name]), name


@pytest.mark.parametrize("unit", [rollup.MONTH, rollup.DAY])
@pytest.mark.parametrize("days,store,schedule", [(None, None, None), (30, 2, None), (7, None, "S4")])
def test_panels_equal_the_direct_ones(spark, unit, days, store, schedule):
    t = _tables(spark, _rows(3))
    made = rollup.VolumeRollup(spark, shared_folder(spark, "rollup"), CLOCK, unit).build(t.dispense)
    want = reports.analytics_report(t, CLOCK, days, store, schedule)
    _same(made.report(t, CLOCK, days, store, schedule), want)


def test_a_late_day_replaces_its_folder(spark, tmp_path):
    rows, path = _rows(5), str(tmp_path / "rollup")
    made = rollup.VolumeRollup(spark, path, CLOCK).build(_tables(spark, rows).dispense)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "rollup").rglob("*.parquet")}
    day = (CLOCK - timedelta(days=45)).date()
    month = [r for r in rows if r["DispensedDate"] and r["DispensedDate"].date().replace(day=1) == day.replace(day=1)]
    assert month
    # Of that month most is gone, and late rows have come.
    rows = [r for r in rows if r not in month[5:]] + [dispense_row(DispensedDate=CLOCK - timedelta(days=45))] * 3
    t = _tables(spark, rows)
    for _ in range(2):  # repeating it changes nothing
        made.replace(t.dispense, [day, day])
        _same(made.report(t, CLOCK, 60), reports.analytics_report(t, CLOCK, 60))
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "rollup").rglob("*.parquet")}
    assert {p.parent.name for p in kept if files.get(p) != kept[p]} == {f"folder=m{day:%Y-%m}"}
    # The last dispense of a folder goes.
    rows = [r for r in rows if not r["DispensedDate"] or r["DispensedDate"].date().replace(day=1) != day.replace(day=1)]
    t = _tables(spark, rows)
    made.replace(t.dispense, [day])
    _same(made.report(t, CLOCK), reports.analytics_report(t, CLOCK))
    assert made.replace(t.dispense, []) is made


def test_panels_read_no_dispenses_and_prune_folders(spark, tmp_path):
    facts = str(tmp_path / "facts.parquet")
    t = _tables(spark, _rows(7))
    t.dispense.write.parquet(facts)
    t = _loaded(spark.read.parquet(facts), t.patients, t.stores)
    made = rollup.VolumeRollup(spark, str(tmp_path / "rollup"), CLOCK).build(t.dispense)
    report = made.report(t, CLOCK, 7)
    for name in PANELS:
        plan = report[name]._jdf.queryExecution().executedPlan().toString()
        assert "facts.parquet" not in plan
    assert "folder#" in report["top_drugs"]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in report["top_drugs"]._jdf.queryExecution().executedPlan().toString()


def test_another_time_of_day_is_refused(spark, tmp_path):
    t = _tables(spark, _rows(9, 20))
    made = rollup.VolumeRollup(spark, str(tmp_path / "rollup"), CLOCK).build(t.dispense)
    with pytest.raises(ValueError):
        made.report(t, CLOCK + timedelta(minutes=1))
    with pytest.raises(ValueError):
        rollup.VolumeRollup(spark, "x", CLOCK, "yyyy")


def _bits(df, column, ids):
    return distinct.bitmaps(df, ids, "StoreId", column)


def test_bitmaps_merge_to_the_same_counts(spark):
    rows = _rows(11) + [dispense_row(StoreId=None), dispense_row(PatPharmSysID=None)]
    df = frame(spark, "dispense", rows)
    shops = spark.createDataFrame(
        [(n, f"Shop {n}", "QLD") for n in range(1, 6)], "PharmacyID int, CommercialName string, TimeZoneState string"
    )
    old, new = (df.where(F.col("ScriptNo") % 2 == k) for k in (0, 1))
    bits = []
    for column in ("PatPharmSysID", "OriginalScriptNumber"):
        first = distinct.dictionary(old, "StoreId", column)
        both = distinct.dictionary(df, "StoreId", column, known=first)
        ids = {(r["StoreId"], r[column]): r["id"] for r in both.collect()}
        assert all(ids[r["StoreId"], r[column]] == r["id"] for r in first.collect())  # old ids stay
        for store in {s for s, _ in ids}:
            mine = sorted(i for (s, _), i in ids.items() if s == store)
            assert mine == list(range(1, len(mine) + 1))  # dense
        parts = _bits(old, column, first).unionByName(_bits(new, column, both))
        bits.append(parts)
    got = stores.store_activity_of_bitmaps(shops, *bits)
    assert sorted(map(str, rows_of(got))) == sorted(map(str, rows_of(stores.store_activity(shops, df))))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_of_many_values(spark):
    df = spark.range(100_000).select((F.col("id") % 3 == 0).alias("g"), (F.col("id") % 70_001).alias("v"))
    ids = distinct.dictionary(df, "g", "v")
    got = distinct.counted(distinct.bitmaps(df, ids, "g", "v"), ["g"], "n")
    want = df.groupBy("g").agg(F.countDistinct("v").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
