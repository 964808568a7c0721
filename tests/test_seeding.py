"""Batches that are added once, dense ids, and sources that fail."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from repeatlens.operators import filters, ranking, refills, stores
from repeatlens.sources import export, seeding
from repeatlens.sources.tables import first_that_runs, load_tables
from tests.frames import CLOCK, frame, rows_of

SCHEMA = StructType([StructField("k", LongType()), StructField("v", StringType())])


@pytest.fixture
def table(spark, tmp_path):
    return seeding.SeededTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])


def _rows(df):
    return sorted(((r["k"], r["v"]) for r in df.collect()), key=str)


def _df(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_batch_is_added_once(spark, table):
    assert table.batches() == [] and _rows(table.read()) == []
    first = _df(spark, (1, "a"), (2, "b"), (None, "c"))
    assert table.seed("one", first) and not table.seed("one", first)
    assert not table.seed("one", _df(spark, (9, "other rows under a known name")))
    assert table.seed("two", _df(spark, (2, "again"), (3, "d"), (None, "e")).withColumn("batch", F.lit(1)))
    assert _rows(table.read()) == [(1, "a"), (2, "b"), (3, "d"), (None, "c"), (None, "e")]
    assert table.seed("none", first.limit(0)) and table.batches() == ["none", "one", "two"]
    with pytest.raises(ValueError, match="a batch is named"):
        table.seed("../one", first)


def test_a_batch_that_failed_half_way_is_written_anew(spark, table, monkeypatch):
    table.seed("one", _df(spark, (1, "a")))
    broken = _df(spark, (2, "b"), (3, "x")).withColumn(
        "v", F.when(F.col("k") == 3, F.raise_error("lost").cast("string")).otherwise(F.col("v"))
    )
    with pytest.raises(Exception, match="lost"):
        table.seed("two", broken)
    assert _rows(table.read()) == [(1, "a")]

    def lost(batch):
        raise RuntimeError("driver lost before the mark")

    with monkeypatch.context() as patch:
        patch.setattr(table, "_mark", lost)
        with pytest.raises(RuntimeError):
            table.seed("two", _df(spark, (2, "b"), (3, "c")))
    assert _rows(table.read()) == [(1, "a")]
    assert table.seed("two", _df(spark, (2, "b"), (3, "c")))
    assert not table.seed("two", _df(spark, (2, "b"), (3, "c")))
    assert _rows(table.read()) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_mark_that_was_not_finished_does_not_count(spark, table, tmp_path):
    table.seed("one", _df(spark, (1, "a")))
    (tmp_path / "t" / "marks" / "two" / "_temporary" / "0").mkdir(parents=True)
    assert table.batches() == ["one"]
    assert table.seed("two", _df(spark, (2, "b"))) and table.batches() == ["one", "two"]


def test_dense_ids_in_many_ranges(spark, conf):
    conf(adaptive__coalescePartitions__enabled="false", shuffle__partitions="13")
    values = random.Random(3).sample(range(10_000), 3000)
    df = spark.createDataFrame([(None if v == values[0] else v, v % 7) for v in values], "a int, _n int")
    got = {r["a"]: r["id"] for r in ranking.dense_ids(df, ["a"]).collect()}
    want = [None, *sorted(values[1:])]
    assert got == {a: k for k, a in enumerate(want, 1)}
    assert ranking.dense_ids(df.limit(0), ["a"]).count() == 0


def test_dense_contacts_are_the_same_in_every_run(spark):
    rows = [{"dispenseid": str(n % 40), "storeid": n % 3 or None} for n in range(300)]
    patients = frame(spark, "patients", [*rows, {"dispenseid": None, "storeid": 1}])
    runs = [
        {(r["patientid"], r["storeid"]): r["id"] for r in rows_of(refills.build_patient_contacts(p, CLOCK, dense=True))}
        for p in (patients, patients.repartition(5))
    ]
    assert runs[0] == runs[1]
    assert sorted(runs[0].values()) == list(range(1, len(runs[0]) + 1))
    loose = refills.build_patient_contacts(patients, CLOCK)
    assert loose.schema.names == refills.build_patient_contacts(patients, CLOCK, dense=True).schema.names
    assert loose.count() == len(runs[0])


def _counts(spark, folder, dispense):
    t = load_tables(spark, str(folder))
    return rows_of(
        first_that_runs(
            spark,
            {
                "patients": lambda: stores.registered_patients(t.wh_patients),
                "dispenses": lambda: stores.dispensed_patients(dispense),
            },
        )
    )


def test_sources_that_fail(spark, tmp_path):
    dispense = frame(spark, "dispense_transactions", [{"StoreId": "1", "PatPharmSysID": p} for p in "aab"])
    by_dispense = {"StoreId": "1", "TotalPatients": 2, "Source": "dispenses"}
    [row] = _counts(spark, tmp_path / "nowhere", dispense)
    assert row.pop("Reason") == "patients: PATH_NOT_FOUND" and row == by_dispense

    folder = tmp_path / "wh" / "wh_patients.parquet"
    kept = frame(spark, "wh_patients", [{"StoreId": "1", "PatientId": n} for n in range(5)])
    export.save_table(kept.repartition(2), str(folder))
    [row] = _counts(spark, tmp_path / "wh", dispense)
    assert row == {"StoreId": "1", "TotalPatients": 5, "Source": "patients", "Reason": None}

    # The footer stays readable, so only a job finds the damage.
    for part in folder.glob("part-*.parquet"):
        data = bytearray(part.read_bytes())
        middle = data.rindex(b"\x15", 0, len(data) - 8)
        data[4 : min(middle, 60)] = b"\xff" * (min(middle, 60) - 4)
        part.write_bytes(data)
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    [row] = _counts(spark, tmp_path / "wh", dispense)
    assert row.pop("Reason").startswith("patients: ") and row == by_dispense

    other = tmp_path / "lacking" / "wh_patients.parquet"
    spark.range(3).write.parquet(str(other))
    with pytest.raises(ValueError, match="lacks the columns"):  # a wrong table is no failing source
        _counts(spark, tmp_path / "lacking", dispense)


def test_all_sources_fail(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        first_that_runs(spark, {"a": lambda: spark.read.schema("x int").parquet(f"{tmp_path}/no")})
    with pytest.raises(ValueError, match="no source"):
        first_that_runs(spark, {})


def test_absent_rows_by_a_hot_key(spark):
    existing = spark.range(1000).selectExpr("IF(id < 400, 1, id) AS k", "'x' AS v")
    new = spark.range(500).selectExpr("id AS k", "'y' AS v")
    assert {r["k"] for r in filters.not_exists_insert(new, existing, ["k"]).collect()} == {0, *range(2, 400)}
