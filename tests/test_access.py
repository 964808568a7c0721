"""Roles, permissions, users, messages."""

import pytest

from repeatlens.operators import access, filters, messages, paging
from tests.frames import CLOCK, frame, rows_of

HARD_SPACE = chr(0xA0)
NAMES = sorted({p for names in access.ROLE_GRANTS.values() for p in names} | {"SYSTEM_ADMIN"})


@pytest.fixture(scope="module")
def roles(spark):
    names = ["Super Admin", *access.ROLE_GRANTS, "Guest"]
    return frame(
        spark,
        "roles",
        [{"RoleID": n, "RoleName": name, "IsActive": int(name != "Viewer")}
         for n, name in enumerate(names, 1)],
    )


@pytest.fixture(scope="module")
def permissions(spark):
    return frame(
        spark,
        "permissions",
        [{"PermissionID": n, "PermissionName": name, "IsActive": int(name != "EXPORT_DATA")}
         for n, name in enumerate(NAMES, 1)],
    )


def test_matrix(roles, permissions):
    got = {}
    for r in rows_of(access.role_permission_matrix(roles, permissions)):
        got.setdefault(r["RoleName"], []).append(r["PermissionName"])
    assert {role: sorted(p) for role, p in got.items()} == {
        "Super Admin": [n for n in NAMES if n != "EXPORT_DATA"],
        **{role: sorted(names) for role, names in access.ROLE_GRANTS.items()},
    }


def test_user_permissions_need_everything_active(spark, roles, permissions):
    people = [
        {"Username": "ana", "RoleID": 2, "StatusUDC": "SUS10"},
        {"Username": "ana", "RoleID": 2, "StatusUDC": "SUS10"},
        {"Username": "bob", "RoleID": 2, "StatusUDC": "SUS20"},
        {"Username": "cy", "RoleID": 5, "StatusUDC": "SUS10"},
        {"Username": "dee", "RoleID": None, "StatusUDC": "SUS10"},
    ]
    users = frame(spark, "users", people)
    grants = frame(
        spark,
        "role_permissions",
        [{"RoleID": r["RoleID"], "PermissionID": r["PermissionID"],
          "IsActive": int(r["PermissionName"] != "VIEW_REPORTS")}
         for r in rows_of(access.role_permission_matrix(roles, permissions))],
    )
    got = rows_of(access.user_permissions(users, roles, grants, permissions))
    expected = set(access.ROLE_GRANTS["Pharmacy Manager"]) - {"EXPORT_DATA", "VIEW_REPORTS"}
    assert sorted((r["Username"], r["PermissionName"]) for r in got) == sorted(
        ("ana", p) for p in expected
    )
    one = access.user_permissions(users, roles, grants, permissions, username="ana")
    assert sorted(rows_of(one), key=str) == sorted(got, key=str)
    assert rows_of(access.user_permissions(users, roles, grants, permissions, "bob")) == []


def test_active_roles_by_name(roles):
    got = [r["RoleName"] for r in rows_of(access.active_roles(roles))]
    assert got == sorted(got) and "Viewer" not in got and len(got) == 5


def test_search_users(spark, roles):
    people = [
        {"Userid": 1, "Firstname": "Ann", "Username": "a1", "RoleID": 3},
        {"Userid": 2, "Lastname": "Analystov", "Username": "b", "RoleID": None},
        {"Userid": 3, "Email": "x@ANALYST.example", "Username": "c", "RoleID": 9},
        {"Userid": 4, "Username": "d", "RoleID": 1},
    ]
    users = frame(spark, "users", people)
    found = lambda term: {r["Userid"] for r in rows_of(access.search_users(users, roles, term))}
    assert found("analyst") == {1, 2, 3}
    assert found("") == {1, 2, 3, 4}
    assert found("_") == set()


def test_dashboard_counts(spark):
    stores = frame(spark, "stores", [{"PharmacyID": n} for n in range(3)])
    users = frame(spark, "users", [{"StatusUDC": s} for s in ("SUS10", "SUS20", None, "SUS10")])
    assert rows_of(access.dashboard_counts(stores, users)) == [{"pharmacies": 3, "users": 2}]
    none = users.where("false")
    assert rows_of(access.dashboard_counts(stores, none)) == [{"pharmacies": 3, "users": 0}]


def test_lookups_and_seeding(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k INT, v STRING")
    keys = spark.createDataFrame([(1,), (1,), (None,), (7,)], "k INT")
    assert {r["v"] for r in rows_of(filters.lookup_by_keys(df, keys, ["k"]))} == {"a", "b"}
    fresh = filters.not_exists_insert(df, keys, ["k"])
    assert {r["v"] for r in rows_of(fresh)} == {"c", "d"}
    # Applying the seed a second time adds nothing new.
    seeded = keys.unionByName(fresh.select("k"))
    again = filters.not_exists_insert(df.na.drop(), seeded, ["k"])
    assert rows_of(again) == []


def test_paging(spark):
    df = spark.range(45)
    assert [r["id"] for r in rows_of(paging.page_rows(df, ["id"], page=3))] == list(range(40, 45))
    assert rows_of(paging.page_rows(df, ["id"], page=4)) == []
    assert rows_of(paging.page_count(df)) == [{"total_rows": 45, "total_pages": 3}]
    assert rows_of(paging.page_count(df.where("false"))) == [{"total_rows": 0, "total_pages": 1}]
    with pytest.raises(ValueError):
        paging.page_rows(df, ["id"], page=0)


@pytest.mark.parametrize(
    "message, intent, store",
    [
        ("BIR 245", "heartbeat", "245"),
        ("bir store 245", "unknown", None),
        ("bir x, Bir  7 and bir 9", "heartbeat", "7"),
        (" bir 245", "unknown", None),
        ("Info 12", "store_info", "12"),
        (f"Info{HARD_SPACE}12", "unknown", None),
        (f"Info {HARD_SPACE}12", "store_info", "12"),
        ("info the info 12", "store_info", "12"),
        ("Show pharmacy 1234", "store_lookup", "1234"),
        ("pharmacy id", "unknown", None),
        ("status of pharmacies", "ask_store_status", None),
        ("Patient 12345 medication history", "ask_patient", None),
        ("patient info", "unknown", None),
        ("Statistics please", "today_stats", None),
        ("recent scripts", "recent_dispenses", None),
        ("Last sales dispense for 245", "last_sale", "245"),
        ("latest dispense 9", "last_dispense", "9"),
        ("latest transaction 9", "no_records", "9"),
        ("last transaction", "ask_store", None),
        ("Stock count for store 245", "stock_counts", "245"),
        ("how many barcodes", "ask_store", None),
        ("error 77", "store_errors", "77"),
        ("errors for store", "ask_store", None),
        ("an issue with 5", "store_errors", "5"),
        ("an issue", "help", None),
        ("a problem", "unknown", None),
        ("TROUBLESHOOT", "help", None),
        ("hello", "unknown", None),
        ("", "empty", None),
        (None, "empty", None),
    ],
)
def test_intents(spark, message, intent, store):
    df = frame(spark, "messages", [{"conv_id": 1, "message": message}])
    got = rows_of(messages.tag_messages(df))[0]
    assert (got["Intent"], got["StoreNumber"]) == (intent, store)


def test_intent_counts(spark):
    texts = ["bir 1", "bir 2", "stock count", "hello"]
    df = frame(spark, "messages", [{"message": t} for t in texts])
    got = {r["Intent"]: (r["Messages"], r["WithStore"]) for r in rows_of(messages.message_intents(df))}
    assert got == {"heartbeat": (2, 2), "ask_store": (1, 0), "unknown": (1, 0)}


def test_newest_users_first(spark, roles):
    people = [{"Userid": n, "CreatedDate": d} for n, d in ((1, None), (2, CLOCK), (3, CLOCK))]
    got = rows_of(access.users_with_roles(frame(spark, "users", people), roles))
    assert [r["Userid"] for r in got] == [2, 3, 1]
