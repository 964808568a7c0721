"""Volume panels against counts made by hand in Python."""

from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from repeatlens.operators import filters, volumes
from tests.frames import CLOCK, dispense_row, frame, random_dispenses, rows_of

ROWS = random_dispenses(400)


@pytest.fixture(scope="module")
def dispense(spark):
    return frame(spark, "dispense", ROWS).cache()


def keep(days=None, store=None, schedule=None):
    start = None if days is None else CLOCK - timedelta(days=days)
    return [
        r
        for r in ROWS
        if (start is None or r["DispensedDate"] >= start)
        and (store is None or r["StoreId"] == store)
        and (schedule is None or r["DrugSchedule"] == schedule)
    ]


@pytest.mark.parametrize("args", [{}, {"days": 7}, {"store": 2}, {"days": 30, "schedule": "S8"}])
def test_summary(dispense, args):
    rows = keep(**args)
    got = rows_of(
        volumes.dispense_summary(
            dispense, CLOCK, args.get("days"), args.get("store"), args.get("schedule")
        )
    )
    assert got[0]["totalDispenses"] == len(rows)
    assert got[0]["totalStores"] == len({r["StoreId"] for r in rows} - {None})
    assert got[0]["totalValue"] == pytest.approx(sum(float(r["DrugVal"]) for r in rows))


def test_nothing_counts_as_zero(dispense):
    got = rows_of(volumes.dispense_summary(dispense, CLOCK, schedule="none"))
    assert got == [{"totalDispenses": 0, "totalValue": 0.0, "totalStores": 0}]


def test_trend_has_its_own_range(dispense):
    got = rows_of(volumes.daily_trend(dispense, CLOCK, store_id=1))
    expected = Counter(r["DispensedDate"].date() for r in keep(days=30, store=1))
    assert [(r["date"], r["count"]) for r in got] == sorted(expected.items(), reverse=True)


def test_window_edge_keeps_the_time_of_day(spark):
    edge = CLOCK - timedelta(days=30)
    df = frame(
        spark,
        "dispense",
        [dispense_row(DispensedDate=edge), dispense_row(DispensedDate=edge - timedelta(seconds=1))],
    )
    assert filters.recent_window(df, "DispensedDate", CLOCK, 30).count() == 1


@pytest.mark.parametrize("by_store", [False, True])
def test_top_drugs(dispense, by_store):
    totals = defaultdict(list)
    for r in keep(days=45):
        if r["Drugname"]:
            totals[(r["StoreId"] if by_store else 0, r["Drugname"], r["BrandName"])].append(r)
    groups = defaultdict(list)
    for (store, drug, brand), rows in totals.items():
        groups[store].append((-len(rows), drug, brand or "", rows))
    expected = []
    for store, drugs in groups.items():
        for rank, (count, drug, brand, rows) in enumerate(sorted(drugs, key=lambda d: d[:3])[:3], 1):
            prices = [r["PatientPrice"] for r in rows if r["PatientPrice"] is not None]
            mean = sum(prices) / len(prices) if prices else 0
            expected.append((store, rank, drug, brand, -count, pytest.approx(mean)))
    got = [
        (r.get("StoreId", 0), r["rank"], r["drugName"], r["brandName"] or "",
         r["totalDispensed"], r["avgPrice"])
        for r in rows_of(volumes.top_drugs(dispense, CLOCK, 45, n=3, by_store=by_store))
    ]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_schedule_mix_keeps_empty_apart(dispense):
    got = {r["category"]: r["count"] for r in rows_of(volumes.schedule_mix(dispense, CLOCK))}
    expected = Counter(
        "Unclassified" if r["DrugSchedule"] is None else r["DrugSchedule"] for r in ROWS
    )
    assert got == expected and "" in got


def test_schedule_options(dispense):
    assert [r["DrugSchedule"] for r in rows_of(volumes.schedule_options(dispense))] == ["S4", "S8"]


def test_store_ranking_leaves_out_unknown_stores(dispense):
    got = rows_of(volumes.store_ranking(dispense, CLOCK, days=20, n=2))
    expected = Counter(r["StoreId"] for r in keep(days=20) if r["StoreId"])
    best = sorted(expected.items(), key=lambda i: (-i[1], i[0]))[:2]
    assert [(r["storeId"], r["count"]) for r in got] == best


def test_gender_words(spark):
    texts = ["Male", "female", "FEMALE patient", "male/female", None, "", "unknown"]
    df = frame(spark, "patients", [{"gender": t} for t in texts])
    got = {r["gender"]: r["count"] for r in rows_of(volumes.gender_mix(df))}
    assert got == {"male": 1, "female": 3}


def test_today_and_newest(dispense):
    day = [r for r in ROWS if r["DispensedDate"].date() == CLOCK.date()]
    got = rows_of(volumes.today_stats(dispense, CLOCK))[0]
    assert got == {
        "UniquePatients": len({r["PatPharmSysID"] for r in day} - {None}),
        "TotalDispenses": len(day),
        "ActiveStores": len({r["StoreId"] for r in day} - {None}),
    }
    newest = sorted(ROWS, key=lambda r: (r["DispensedDate"], r["ScriptNo"]), reverse=True)[:10]
    got = rows_of(volumes.recent_dispenses(dispense))
    assert [r["ScriptNo"] for r in got] == [r["ScriptNo"] for r in newest]


@pytest.mark.parametrize("term, count", [("ASP", "aspirin"), ("%s", "100% salt"), ("\\", None)])
def test_drug_filter_reads_like_patterns(dispense, term, count):
    got = {r["Drugname"] for r in rows_of(filters.dispense_filter(dispense, CLOCK, drug=term))}
    wildcard = {"%s": {"aspirin", "100% salt"}}
    assert got == wildcard.get(term, {count} - {None})
