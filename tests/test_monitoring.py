"""Per-store monitoring reports."""

from datetime import timedelta

import pytest

from repeatlens.operators import monitoring, stores
from tests.frames import CLOCK, dispense_row, frame, rows_of


def test_heartbeat_classes(spark):
    ages = {1: 30, 2: 31, 3: 60, 4: 61, 5: -5, 6: 0, 7: None}
    pings = [{"StoreId": s, "ping": CLOCK - timedelta(minutes=a)} for s, a in ages.items()
             if a is not None]
    pings += [{"StoreId": s, "ping": CLOCK - timedelta(hours=9)} for s in (1, 4, 4)]
    pings += [{"StoreId": 7, "ping": None}, {"StoreId": None, "ping": CLOCK}]
    listed = [{"PharmacyID": s, "BIRExtractionFlag": 1} for s in range(1, 9)]
    listed[5]["BIRExtractionFlag"] = 0
    listed.append({"PharmacyID": 9, "BIRExtractionFlag": None})
    got = {
        r["StoreId"]: (r["Status"], r["MinutesSinceLast"])
        for r in rows_of(
            monitoring.heartbeat_status(
                frame(spark, "stores", listed), frame(spark, "pings", pings), CLOCK
            )
        )
    }
    assert got == {
        1: ("Healthy", 30),
        2: ("Warning", 31),
        3: ("Warning", 60),
        4: ("Critical", 61),
        5: ("Healthy", -5),
        6: ("Inactive", None),
        7: ("Unknown", None),
        8: ("NoData", None),
        9: ("Inactive", None),
    }


def test_previous_ping(spark):
    times = [CLOCK - timedelta(minutes=m) for m in (5, 35, 65)]
    pings = [{"StoreId": 1, "ping": t} for t in times] + [{"StoreId": 2, "ping": times[0]}]
    got = {r["StoreId"]: r for r in rows_of(monitoring.heartbeat_pings(frame(spark, "pings", pings)))}
    assert (got[1]["lastping"], got[1]["previousping"]) == (times[0], times[1])
    assert (got[2]["lastping"], got[2]["previousping"]) == (times[0], None)


def error_rows():
    """Store 1 has more errors than the cap; the oldest ones are of their own type."""
    rows = [
        {
            "PharmacyId": "1",
            "ErrorID": n,
            "ErrorTypeUDC": "old" if n < 20 else ("new", None, "")[n % 3],
            "ErrorSource": "SYNC" if n % 2 else None,
            "ErrorDate": CLOCK - timedelta(days=2) + timedelta(minutes=n),
            "ErrorMessage": "m" * n,
        }
        for n in range(70)
    ]
    rows.append({"PharmacyId": "2", "ErrorID": 900, "ErrorDate": CLOCK - timedelta(days=3)})
    rows.append(
        {"PharmacyId": "2", "ErrorID": 901, "ErrorDate": CLOCK - timedelta(days=3, seconds=1)}
    )
    return rows


def test_error_summaries_count_the_latest_only(spark):
    df = frame(spark, "errors", error_rows())
    types = {
        (r["PharmacyId"], r["ErrorType"]): r["ErrorCount"]
        for r in rows_of(monitoring.error_type_summary(df, CLOCK))
    }
    unknown = sum(n % 3 != 0 for n in range(20, 70))
    assert types == {("1", "new"): 50 - unknown, ("1", "Unknown"): unknown, ("2", "Unknown"): 1}
    whole = rows_of(monitoring.error_type_summary(df, CLOCK, cap=None, store_id=1))
    assert {r["ErrorType"]: r["ErrorCount"] for r in whole}["old"] == 20
    sources = rows_of(monitoring.error_source_summary(df, CLOCK, store_id=1))
    assert {r["ErrorSource"]: r["ErrorCount"] for r in sources} == {"SYNC": 25, "Unknown": 25}


def test_recent_errors_detail(spark):
    df = frame(spark, "errors", error_rows())
    got = rows_of(monitoring.recent_errors(df, CLOCK, n=5, store_id="1"))
    assert sorted(r["ErrorID"] for r in got) == [65, 66, 67, 68, 69]
    assert {len(r["MessagePreview"]) for r in got} == {63}
    assert rows_of(monitoring.recent_errors(df, CLOCK, store_id="2"))[0]["MessagePreview"] == "N/A"


MESSAGES = {
    1: "SQLITE ERROR no such table: department_pos",
    2: "xx NO SUCH TABLE: Department_POS yy",
    3: "bulk copy failed",
    4: "no such table: Department_X",
    5: None,
    6: "line one\nno such table: Department_Y",
}


def flagged(spark, **kwargs):
    df = frame(spark, "errors", [{"ErrorID": k, "ErrorMessage": v} for k, v in MESSAGES.items()])
    return {r["ErrorID"]: r["IgnoreReason"] for r in rows_of(monitoring.flag_ignored_errors(df, **kwargs))}


def test_rules_in_order(spark):
    got = flagged(spark)
    assert got == {
        1: "Department_POS table is not used in current implementation",
        2: "Alternative pattern for Department_POS table error",
        3: "Alternative pattern for Bulk Copy Failed",
        4: None,
        5: None,
        6: None,
    }


def test_case_sensitive_rules(spark):
    got = flagged(spark, case_sensitive=True)
    assert {k for k, v in got.items() if v} == set()


def test_regex_rules_come_last_and_broken_ones_are_skipped(spark):
    rule = monitoring.IgnoreRule
    rules = [
        rule("[", "broken", is_regex=True),
        rule("^.*department_.*$", "regex", is_regex=True),
        rule("Department_X", "substring"),
        rule("copy", "off", enabled=False),
    ]
    got = flagged(spark, rules=rules)
    # The pattern is anchored and does not cross lines.
    assert got == {1: "regex", 2: "regex", 3: None, 4: "substring", 5: None, 6: None}
    assert flagged(spark, rules=rules, use_regex=False)[1] is None


def test_last_sale_and_dispense(spark):
    sales = frame(
        spark,
        "sales",
        [{"StoreId": "1", "SalesDate": CLOCK - timedelta(hours=h)} for h in (3, 1, 2)]
        + [{"StoreId": None, "SalesDate": CLOCK}],
    )
    assert rows_of(monitoring.last_sale(sales)) == [
        {"StoreId": "1", "LastSalesDate": "2024-03-15 09:30:00", "TotalRecords": 3}
    ]
    assert rows_of(monitoring.last_sale(sales, store_id=2)) == []
    rows = [dispense_row(ScriptNo=n, Drugname=f"d{n}") for n in (1, 3, 2)]
    got = rows_of(monitoring.last_dispense(frame(spark, "dispense", rows), store_id=1))
    assert [(r["ScriptNo"], r["Drugname"], r["TotalRecords"]) for r in got] == [(3, "d3", 3)]


@pytest.fixture(scope="module")
def listed(spark):
    names = {1: "North", 2: "Chemist discount centre East", 3: None, 4: "Quiet"}
    return frame(
        spark,
        "stores",
        [{"PharmacyID": s, "CommercialName": n, "TimeZoneState": "QLD", "BIRExtractionFlag": s % 2}
         for s, n in names.items()],
    )


def test_stores_without_data_stay(spark, listed):
    rows = [dispense_row(StoreId=s, PatPharmSysID=p) for s, p in ((1, "a"), (1, "b"), (9, "c"))]
    dispense = frame(spark, "dispense", rows)
    got = {r["StoreId"]: r for r in rows_of(stores.store_activity(listed, dispense))}
    assert {s: r["UniquePatients"] for s, r in got.items()} == {1: 2, 2: 0, 3: 0, 4: 0}
    assert got[1]["UniqueScripts"] == 1
    single = rows_of(stores.store_activity(listed, dispense, store_id=1))
    assert single == [got[1]]


def test_store_names(spark, listed):
    rows = [dispense_row(StoreId=s) for s in (1, 2, 2, 3, 9, None)]
    dispense = frame(spark, "dispense", rows)
    got = rows_of(stores.adherence_stores(dispense, listed, min_rows=0))
    assert [(r["storeId"], r["storeName"], r["recordCount"]) for r in got] == [
        (2, "CDC East", 2), (1, "North", 1), (3, "Store 3", 1), (9, "Store 9", 1),
    ]
    assert rows_of(stores.adherence_stores(dispense, listed, min_rows=1))[0]["storeId"] == 2
    assert [r["storeName"] for r in rows_of(stores.store_filter_options(dispense, listed))] == [
        "North", "Chemist discount centre East", None, None,
    ]


def test_search_stores(listed):
    found = lambda term: {r["PharmacyID"] for r in rows_of(stores.search_stores(listed, term))}
    assert found("") == {1, 2, 3, 4}
    assert found("NORTH") == {1}
    assert found("qld") == {1, 2, 3, 4}
    assert found("3") == {3}
    assert found("%") == set()


def test_store_360_fills_missing_sources(spark, listed):
    empty = {name: frame(spark, name, []) for name in ("sales", "stock", "ean_links")}
    wh = frame(spark, "wh_patients", [{"StoreId": "1", "PatientId": n % 2} for n in range(4)])
    dispense = frame(
        spark, "dispense", [dispense_row(StoreId=s, PatPharmSysID=str(n)) for n in range(3)
                            for s in (1, 2)]
    )
    pings = frame(spark, "pings", [{"StoreId": s, "ping": CLOCK} for s in (1, 2)])
    got = {
        r["StoreId"]: r
        for r in rows_of(
            stores.store_360(listed, empty["sales"], empty["stock"], empty["ean_links"], wh,
                             dispense, pings)
        )
    }
    assert {s: r["TotalPatients"] for s, r in got.items()} == {1: 2, 2: 3, 3: 0, 4: 0}
    assert {s: r["LastPing"] for s, r in got.items()} == {
        1: "2024-03-15 10:30:00", 2: None, 3: None, 4: None,
    }
    assert got[4]["TotalSales"] == got[4]["StockCount"] == got[4]["TotalLinks"] == 0
