"""Refill predictions: classes, ties, filters and joins."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from repeatlens.functions.clock import moment
from repeatlens.operators import refills
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of

PATIENTS = [
    {"dispenseid": p, "storeid": s} for p in ("p1", "p2", "p3") for s in (1, 2)
] + [{"dispenseid": None, "storeid": 1}, {"dispenseid": "p1", "storeid": 1}]


@pytest.fixture(scope="module")
def contacts(spark):
    return refills.build_patient_contacts(frame(spark, "patients", PATIENTS), CLOCK).cache()


def test_contacts_are_unique_and_stamped(contacts):
    rows = rows_of(contacts)
    assert len(rows) == 6
    assert len({r["id"] for r in rows}) == 6
    assert {(r["patientid"], r["storeid"], r["contactemail"]) for r in rows} == {
        (p, s, f"patient{p}@example.com") for p in ("p1", "p2", "p3") for s in (1, 2)
    }
    assert {r["created_at"] for r in rows} == {r["updated_at"] for r in rows} == {CLOCK}


@pytest.mark.parametrize(
    "predicted, label",
    [
        ("2024-03-14 23:59:59", "Overdue"),
        ("2024-03-15 00:00:00", "Due Today"),
        ("2024-03-15 09:00:00", "Due Today"),
        ("2024-03-15 23:59:59", "Due Today"),
        ("2024-03-16 00:00:00", "Due Tomorrow"),
        ("2024-03-16 23:59:59", "Due Tomorrow"),
        ("2024-03-17 00:00:00", "Due This Week"),
        ("2024-03-22 10:30:00", "Due This Week"),
        ("2024-03-22 10:30:01", "Due Next Week"),
        ("2024-03-29 10:30:00", "Due Next Week"),
        ("2024-03-29 10:30:01", "Due Later"),
    ],
)
def test_urgency_boundaries(spark, predicted, label):
    assert spark.range(1).select(refills.refill_urgency(moment(predicted), CLOCK)).first()[0] == label


def predictions(spark, contacts, rows, **kwargs):
    return rows_of(
        refills.refill_predictions(frame(spark, "dispense", rows), contacts, CLOCK, **kwargs)
    )


def test_repeats_are_checked_after_the_latest_row(spark, contacts):
    # The newest dispense used the last repeat, so the older open one does not count.
    rows = [
        dispense_row(RepeatNo=4, TotalRepeats=5, DispensedDate=CLOCK - timedelta(days=40)),
        dispense_row(RepeatNo=5, TotalRepeats=5, DispensedDate=CLOCK - timedelta(days=39)),
    ]
    assert predictions(spark, contacts, rows) == []


def test_repeat_total_is_checked_before_the_latest_row(spark, contacts):
    rows = [
        dispense_row(RepeatNo=1, TotalRepeats=5, DispensedDate=CLOCK - timedelta(days=40)),
        dispense_row(RepeatNo=0, TotalRepeats=1, DispensedDate=CLOCK - timedelta(days=39)),
    ]
    got = predictions(spark, contacts, rows)
    assert [(r["RepeatNo"], r["RepeatsRemaining"]) for r in got] == [(1, 4)]


@pytest.mark.parametrize("back, kept", [(timedelta(days=44), 1), (timedelta(days=44, seconds=1), 0)])
def test_look_back_edge(spark, contacts, back, kept):
    assert len(predictions(spark, contacts, [dispense_row(DispensedDate=CLOCK - back)])) == kept


@pytest.mark.parametrize("days, kept", [(3, 1), (2, 0)])
def test_days_edge(spark, contacts, days, kept):
    row = dispense_row(DispensedDate=CLOCK - timedelta(days=27))
    assert len(predictions(spark, contacts, [row], days=days)) == kept


def test_ties_are_settled_by_script_then_value(spark, contacts):
    day = CLOCK - timedelta(days=35)
    rows = [
        dispense_row(DispensedDate=day, ScriptNo=3, DrugVal="9", BrandName="wrong"),
        dispense_row(DispensedDate=day, ScriptNo=4, DrugVal="1", BrandName="wrong"),
        dispense_row(DispensedDate=day, ScriptNo=4, DrugVal="2", BrandName="right"),
    ]
    for order in (rows, rows[::-1]):
        assert [r["BrandName"] for r in predictions(spark, contacts, order)] == ["right"]


def test_only_the_summary_counts_unnamed_drugs(spark, contacts):
    rows = [
        dispense_row(Drugname=None, DispensedDate=CLOCK - timedelta(days=35)),
        dispense_row(DispensedDate=CLOCK - timedelta(days=29)),
    ]
    df = frame(spark, "dispense", rows)
    assert len(predictions(spark, contacts, rows)) == 1
    assert rows_of(refills.refill_summary(df, contacts, CLOCK)) == [
        {
            "TotalPredictions": 2,
            "Overdue": 1,
            "DueToday": 0,
            "DueThisWeek": 2,
            "DueInSelectedPeriod": 2,
            "UniquePatients": 1,
        }
    ]


def test_empty_summary_is_zero(spark, contacts):
    got = rows_of(refills.refill_summary(frame(spark, "dispense", []), contacts, CLOCK))
    assert set(got[0].values()) == {0}


def test_repeated_contacts_do_not_multiply_rows(spark, contacts):
    df = frame(spark, "dispense", random_dispenses(200, seed=3))
    doubled = contacts.unionByName(contacts.withColumn("contactemail", F.lit("z@example.com")))
    for operator in (
        lambda c: refills.refill_predictions(df, c, CLOCK, 30),
        lambda c: refills.dispense_with_contact(df, c),
    ):
        assert Counter(operator(contacts).collect()) == Counter(operator(doubled).collect())


def loop_predictions(rows, days):
    """The report as loops: join, filter, latest row, eligibility."""
    reachable = {(r["dispenseid"], r["storeid"]) for r in PATIENTS if r["dispenseid"]}
    latest = {}
    for r in rows:
        if (r["PatPharmSysID"], r["StoreId"]) not in reachable or not r["Drugname"]:
            continue
        if (r["TotalRepeats"] or 0) <= 1 or r["DispensedDate"] < CLOCK - timedelta(days=44):
            continue
        key = (r["StoreId"], r["PatPharmSysID"], r["Drugname"])
        rank = (r["DispensedDate"], r["ScriptNo"])
        if key not in latest or rank > (latest[key]["DispensedDate"], latest[key]["ScriptNo"]):
            latest[key] = r
    found = Counter()
    for (store, patient, drug), r in latest.items():
        due = r["DispensedDate"] + timedelta(days=30)
        if r["RepeatNo"] is None or r["RepeatNo"] >= r["TotalRepeats"]:
            continue
        if due <= CLOCK + timedelta(days=days):
            left = (due.date() - CLOCK.date()).days
            found[(store, patient, drug, due.date().isoformat(), left)] += 1
    return found


@pytest.mark.parametrize("days", [3, 30])
def test_against_loops_and_per_store(spark, contacts, days):
    rows = random_dispenses(500, seed=11)
    df = frame(spark, "dispense", rows)
    names = ("StoreId", "PatientId", "Drugname", "PredictedRefillDate", "DaysUntilDue")
    whole = rows_of(refills.refill_predictions(df, contacts, CLOCK, days))
    assert Counter(tuple(r[n] for n in names) for r in whole) == loop_predictions(rows, days)
    assert {r["Urgency"] for r in whole} <= set(refills.URGENCY_CLASSES)
    for store in (1, 2, 3):
        single = rows_of(refills.refill_predictions(df, contacts, CLOCK, days, store_id=store))
        assert single == [r for r in whole if r["StoreId"] == store]
    total = rows_of(refills.refill_summary(df, contacts, CLOCK, days))[0]["TotalPredictions"]
    assert total >= len(whole)
    stores = rows_of(refills.refill_summary(df, contacts, CLOCK, days, by_store=True))
    assert sum(r["TotalPredictions"] for r in stores) == total


def test_order_is_urgency_date_patient(spark, contacts):
    rows = [
        dispense_row(PatPharmSysID=p, DispensedDate=CLOCK - timedelta(days=d))
        for p, d in (("p2", 31), ("p1", 31), ("p3", 30), ("p1", 36))
    ]
    rows[3]["StoreId"] = 2
    got = predictions(spark, contacts, rows)
    assert [(r["Urgency"], r["PatientId"]) for r in got] == [
        ("Overdue", "p1"), ("Overdue", "p1"), ("Overdue", "p2"), ("Due Today", "p3"),
    ]
    assert [r["DaysUntilDue"] for r in got] == [-6, -1, -1, 0]


def test_clock_text_and_datetime_agree(spark, contacts):
    df = frame(spark, "dispense", random_dispenses(100))
    a = refills.refill_predictions(df, contacts, "2024-03-15 10:30:00", 30).collect()
    assert a == refills.refill_predictions(df, contacts, datetime(2024, 3, 15, 10, 30), 30).collect()
