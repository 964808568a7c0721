"""Refills from a stored state against refills from all dispenses."""

import random

from repeatlens.operators import refills
from repeatlens.plans.refill_state import RefillState
from repeatlens.sources import export
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of


def _contacts(spark):
    rows = [{"dispenseid": p, "storeid": s} for p in ("p1", "p2", "p3") for s in (1, 2)]
    return refills.build_patient_contacts(frame(spark, "patients", rows), CLOCK)


def _plain(df):
    return sorted(map(repr, rows_of(df)))


def _same(state, dispense, contacts):
    for days in (3, 30):
        want = refills.refill_predictions(dispense, contacts, CLOCK, days)
        assert _plain(state.predictions(CLOCK, days)) == _plain(want)
        for by_store in (False, True):
            want = refills.refill_summary(dispense, contacts, CLOCK, days, by_store=by_store)
            assert _plain(state.summary(CLOCK, days, by_store=by_store)) == _plain(want)
    want = refills.refill_predictions(dispense, contacts, CLOCK, 30, store_id=2)
    assert _plain(state.predictions(CLOCK, 30, store_id=2)) == _plain(want)


def test_batches_in_any_order_and_twice(spark, tmp_path):
    rows = random_dispenses(300)
    random.Random(2).shuffle(rows)
    parts = [frame(spark, "dispense", rows[k::3]) for k in range(3)]
    contacts = _contacts(spark)
    state = RefillState(spark, f"{tmp_path}/s0", buckets=4).build(parts[0], contacts)
    _same(state, parts[0], contacts)
    for k, part in enumerate([parts[2], parts[1], parts[2]], 1):
        state = state.add(part, f"{tmp_path}/s{k}")
    _same(state, frame(spark, "dispense", rows), contacts)
    assert refills.refill_predictions(frame(spark, "dispense", rows), contacts, CLOCK, 30).count() > 0
    opened = RefillState(spark, f"{tmp_path}/s3", buckets=4)
    assert _plain(opened.latest()) == _plain(state.latest())


def test_empty_tables(spark, tmp_path):
    none, contacts = frame(spark, "dispense", []), _contacts(spark)
    state = RefillState(spark, f"{tmp_path}/a", buckets=2).build(none, contacts.limit(0))
    assert state.predictions(CLOCK).count() == 0
    assert rows_of(state.summary(CLOCK))[0]["TotalPredictions"] == 0


def test_no_shuffle_below_the_sort(spark, conf, tmp_path):
    conf(autoBroadcastJoinThreshold="-1")
    rows = frame(spark, "dispense", random_dispenses(200))
    state = RefillState(spark, f"{tmp_path}/a", buckets=4).build(rows, _contacts(spark))
    plan = state.predictions(CLOCK, 30)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" not in plan
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_a_hot_patient_is_one_row_for_each_drug(spark, tmp_path):
    rows = [dispense_row(ScriptNo=n, Drugname=f"d{n % 2}") for n in range(500)]
    state = RefillState(spark, f"{tmp_path}/a", buckets=2).build(frame(spark, "dispense", rows), _contacts(spark))
    assert sorted(r["ScriptNo"] for r in rows_of(state.latest())) == [498, 499]


def test_files_of_a_store(spark, tmp_path):
    many = [dispense_row(PatPharmSysID=f"p{n}", StoreId=1 + (n % 3 == 0)) for n in range(300)]
    patients = frame(spark, "patients", [{"dispenseid": r["PatPharmSysID"], "storeid": r["StoreId"]} for r in many])
    listed = refills.refill_predictions(frame(spark, "dispense", many), refills.build_patient_contacts(patients, CLOCK), CLOCK, 30)
    export.export_refills_csv(listed, f"{tmp_path}/out", per_store=True)
    files = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "out").glob("StoreId=*")}
    assert set(files) == {"StoreId=1", "StoreId=2"} and sum(files.values()) <= 8 + 2
    got = sum(export.read_refills_csv(spark, f"{tmp_path}/out/{name}").count() for name in files)
    assert got == listed.count() == 300
