"""Profiles, table loading, exports and report bundles."""

import re
from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from repeatlens.operators import adherence, profile, refills, stores, volumes
from repeatlens.plans import reports
from repeatlens.sources import export, tables
from repeatlens.sources.sample import sample_tables
from repeatlens.sources.schemas import SCHEMAS, WAREHOUSE_TABLES
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dispense(spark):
    return frame(spark, "dispense", random_dispenses(300, seed=21)).cache()


def test_column_profile(dispense):
    rows = random_dispenses(300, seed=21)
    got = rows_of(profile.column_profile(dispense))
    assert [r["column_name"] for r in got] == dispense.columns
    for r in got:
        values = [row[r["column_name"]] for row in rows]
        known = [v for v in values if v is not None]
        assert r["null_count"] == len(values) - len(known)
        assert r["distinct_count"] == len(set(known))
        if r["data_type"] in ("string", "int", "bigint", "double"):
            assert (r["min_value"], r["max_value"]) == (str(min(known)), str(max(known)))


def test_column_profile_of_nothing_and_sketch(dispense):
    got = rows_of(profile.column_profile(dispense.where("false")))
    assert len(got) == len(dispense.columns)
    assert {(r["null_count"], r["distinct_count"], r["min_value"]) for r in got} == {(0, 0, None)}
    exact = rows_of(profile.column_profile(dispense))
    sketch = rows_of(profile.column_profile(dispense, approximate=True))
    for a, b in zip(exact, sketch):
        assert a["distinct_count"] == pytest.approx(b["distinct_count"], rel=0.15)
        assert {k: v for k, v in a.items() if k != "distinct_count"} == {
            k: v for k, v in b.items() if k != "distinct_count"
        }


def test_column_profile_reads_each_column_apart(spark, tmp_path):
    """No row is multiplied, and names may be those the profile uses itself."""
    rows = [(1, "x", None, True), (1, None, 2.5, False), (None, "y", 0.5, None), (3, "y", 0.5, True)]
    names = ["value", "rows", "a.b", "position"]
    spark.createDataFrame(rows, "value int, rows string, `a.b` double, position boolean").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    for sketch in (False, True):
        got = [tuple(r) for r in profile.column_profile(stored, sketch).drop("data_type", "nullable").collect()]
        assert got == [
            (1, names[0], 1, 2, "1", "3"),
            (2, names[1], 1, 2, "x", "y"),
            (3, names[2], 1, 2, "0.5", "2.5"),
            (4, names[3], 1, 2, "false", "true"),
        ]
    plan = profile.column_profile(stored)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sorted(r.split(":")[0] for r in read) == sorted(names)
    assert "Expand" not in plan and plan.count("Generate") <= 1  # that of the list of columns
    counts = profile.table_row_counts({"t": stored})._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in counts  # rows are counted from the footers


def test_profile_lines_and_bundle(dispense):
    lines = {(r["section"], r["name"]): r["value"]
             for r in rows_of(reports.profile_lines(dispense, "DispensedDate", "StoreId"))}
    assert lines["size", "rows"] == "300"
    assert sum(section == "keys" for section, _ in lines) == 3
    with reports.table_profile(dispense, "DispensedDate", "StoreId") as report:
        assert report["rows"].first()["total_rows"] == 300
        assert report["sample"].count() == 3
        assert report["coverage"].first()["UniqueDays"] == int(lines["coverage", "UniqueDays"])


def test_load_tables_checks_schemas(spark, tmp_path):
    for name in SCHEMAS:
        folder = tmp_path / ("wh" if name in WAREHOUSE_TABLES else "cfg")
        frame(spark, name, []).write.parquet(f"{folder}/{name}.parquet")
    loaded = tables.load_tables(spark, f"{tmp_path}/cfg", f"{tmp_path}/wh")
    assert set(loaded.names()) == set(SCHEMAS)
    for name, df in loaded.as_dict().items():
        assert [(f.name, f.dataType) for f in df.schema] == [
            (f.name, f.dataType) for f in SCHEMAS[name]
        ]
    with pytest.raises(AttributeError):
        loaded.nothing


def test_load_tables_casts_and_refuses(spark):
    def reader(folder, name):
        if name == "sales":
            return spark.createDataFrame([(7, "2024-01-01 08:00:00")], "StoreId INT, SalesDate STRING")
        return spark.createDataFrame([("x",)], "other STRING")

    loaded = tables.load_tables(spark, "anywhere", reader=reader)
    assert rows_of(loaded.sales)[0]["StoreId"] == "7"
    with pytest.raises(ValueError, match="stock lacks the columns StoreId"):
        _ = loaded.stock


def test_jdbc_reader_settings():
    """The settings only; there is no database to read from here."""
    seen = {}

    class Recorder:
        read = property(lambda self: self)

        def format(self, kind):
            seen["format"] = kind
            return self

        def options(self, **settings):
            seen.update(settings)
            return self

        def load(self):
            return "rows"

    split = tables.Split("StoreId", "0", "1000", 64)
    read = tables.jdbc_reader(Recorder(), "jdbc:x", {"sales": split}, fetchsize="10000")
    assert read("dbo", "sales") == "rows"
    assert seen == {
        "format": "jdbc",
        "url": "jdbc:x",
        "dbtable": "dbo.sales",
        "fetchsize": "10000",
        "partitionColumn": "StoreId",
        "lowerBound": "0",
        "upperBound": "1000",
        "numPartitions": "64",
    }
    seen.clear()
    read("dbo", "stock")
    assert "numPartitions" not in seen


def test_sql_parameters_are_values(spark, dispense):
    tables.Tables({"shots": lambda: dispense}).register()
    got = tables.run_sql(
        spark, "SELECT count(*) AS n FROM shots WHERE Drugname = :drug", drug="x' OR '1'='1"
    )
    assert got.first()["n"] == 0


def test_unique_keys(spark):
    df = spark.createDataFrame([(1,), (2,)], "k INT")
    assert tables.require_unique(df, ["k"]) is df
    with pytest.raises(ValueError, match="repeats the key"):
        tables.require_unique(df.union(df), ["k"], "stores")


def test_csv_round_trip(spark, tmp_path):
    rows = [
        dispense_row(Drugname='say "a", b', BrandName=None, DispensedDate=CLOCK - timedelta(days=30)),
        dispense_row(StoreId=2, DispensedDate=CLOCK - timedelta(days=31)),
    ]
    patients = frame(spark, "patients", [{"dispenseid": "p1", "storeid": s} for s in (1, 2)])
    contacts = refills.build_patient_contacts(patients, CLOCK)
    listed = refills.refill_predictions(frame(spark, "dispense", rows), contacts, CLOCK)
    path = export.export_refills_csv(listed, f"{tmp_path}/out")
    got = rows_of(export.read_refills_csv(spark, path))
    assert [r["Medication"] for r in got] == ["aspirin", 'say "a", b']
    assert [r["Days Until Due"] for r in got] == ["-1", None]
    assert got[1]["Brand"] is None and got[1]["Repeats Remaining"] == "4"
    parts = [p.read_text() for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    assert all(t.startswith("Patient ID,Medication,Brand,Last Dispense,") for t in parts)
    stored = export.export_refills_csv(listed, f"{tmp_path}/stores", per_store=True)
    assert {p.name for p in (tmp_path / "stores").glob("StoreId=*")} == {"StoreId=1", "StoreId=2"}
    one = export.read_refills_csv(spark, f"{stored}/StoreId=2")
    assert [r["Medication"] for r in rows_of(one)] == ["aspirin"]
    assert export.refill_file_name("CDC North", CLOCK) == "refill-predictions-CDC-North-2024-03-15.csv"


def test_saved_contacts_keep_their_ids(spark, tmp_path):
    patients = frame(spark, "patients", [{"dispenseid": str(n), "storeid": n % 3} for n in range(50)])
    saved = export.save_table(refills.build_patient_contacts(patients, CLOCK), f"{tmp_path}/c")
    first = {r["patientid"]: r["id"] for r in rows_of(saved)}
    assert first == {r["patientid"]: r["id"] for r in rows_of(saved.orderBy("contactemail"))}
    assert len(set(first.values())) == 50


def test_sorted_layout_separates_dates(spark, conf, tmp_path, dispense):
    conf(adaptive__coalescePartitions__enabled="false")
    order = ["DispensedDate", "StoreId", "ScriptNo"]
    saved = export.save_table(dispense.repartition(4), f"{tmp_path}/d", sort_by=order)
    assert same(saved, dispense)
    spans = sorted(
        (r["low"], r["high"])
        for r in saved.groupBy("_metadata.file_path")
        .agg(F.min("DispensedDate").alias("low"), F.max("DispensedDate").alias("high"))
        .collect()
    )
    assert len(spans) > 1
    assert all(left[1] <= right[0] for left, right in zip(spans, spans[1:]))


def test_shared_folder_is_the_configured_one(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    a, b = export.shared_folder(spark, "x"), export.shared_folder(spark, "x")
    assert a.startswith(f"{root}/x-") and a != b


def same(a, b):
    """Equal as multisets; the last digits of an average depend on the order of its terms."""

    def cells(row):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in row)

    return a.columns == b.columns and Counter(map(cells, a.collect())) == Counter(
        map(cells, b.collect())
    )


@pytest.mark.parametrize(
    "args",
    [
        {},
        {"days": 20},
        {"store_id": 2, "days": 45},
        {"schedule": "S8", "store_id": 1},
        {"days": 10, "keep": "table"},
        {"days": 90, "keep": "lazy"},
    ],
)
def test_analytics_report_equals_its_operators(spark, dispense, args):
    patients = frame(spark, "patients", [{"dispenseid": "p", "gender": "Male"}])
    listed = frame(spark, "stores", [{"PharmacyID": 1, "CommercialName": "One"}])
    t = tables.Tables(
        {"dispense": lambda: dispense, "patients": lambda: patients, "stores": lambda: listed}
    )
    days, store, schedule = args.get("days"), args.get("store_id"), args.get("schedule")
    expected = {
        "summary": volumes.dispense_summary(dispense, CLOCK, days, store, schedule),
        "patients": volumes.patient_total(patients),
        "daily_trend": volumes.daily_trend(dispense, CLOCK, store, schedule),
        "top_drugs": volumes.top_drugs(dispense, CLOCK, days, store, schedule),
        "schedule_mix": volumes.schedule_mix(dispense, CLOCK, days, store, schedule),
        "store_ranking": volumes.store_ranking(dispense, CLOCK, days, schedule),
        "gender_mix": volumes.gender_mix(patients),
        "stores": stores.store_filter_options(dispense, listed),
        "schedules": volumes.schedule_options(dispense),
    }
    with reports.analytics_report(t, CLOCK, **args) as report:
        assert set(report.panels) == set(expected)
        for name, df in expected.items():
            assert same(report[name], df), name


@pytest.mark.parametrize(
    "args", [{}, {"store_id": 3, "days": 50, "min_repeats": 3, "drug": "a", "keep": "table"}]
)
def test_adherence_report_equals_its_operators(spark, dispense, args):
    listed = frame(spark, "stores", [{"PharmacyID": n} for n in (1, 3)])
    t = tables.Tables({"dispense": lambda: dispense, "stores": lambda: listed})
    with reports.adherence_report(t, CLOCK, **args) as report:
        args = {name: value for name, value in args.items() if name != "keep"}
        for name, operator in {
            "summary": adherence.adherence_summary,
            "medication_compliance": adherence.medication_compliance,
            "compliance_by_repeat": adherence.compliance_by_repeat,
            "medication_gaps": adherence.medication_gaps,
            "chronic_medications": adherence.chronic_medications,
        }.items():
            assert same(report[name], operator(dispense, CLOCK, **args)), name
        activity = stores.store_activity(listed, dispense, args.get("store_id"))
        assert same(report["store_activity"], activity)


def test_reports_refuse_unknown_keeping(spark, dispense):
    with pytest.raises(ValueError, match="keep is"):
        reports.analytics_report(tables.Tables({"dispense": lambda: dispense}), CLOCK, keep="disk")


def test_refill_report_equals_its_operators(spark):
    t = sample_tables(spark, SF_DIR)
    with reports.refill_report(t, registry.DISPENSE_CLOCK, 30) as report:
        expected = refills.refill_predictions(t.dispense, t.contacts, registry.DISPENSE_CLOCK, 30)
        assert report["predictions"].collect() == expected.collect()
        counts = refills.refill_summary(t.dispense, t.contacts, registry.DISPENSE_CLOCK, 30)
        assert same(report["summary"], counts)
        assert same(report["store"], stores.store_contacts(t.stores, t.contacts))
