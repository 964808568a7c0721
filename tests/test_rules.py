"""Rules in a table against rules in a list, and against plain Python."""

import random

from repeatlens.operators import monitoring, rules
from repeatlens.operators.monitoring import IgnoreRule
from tests.frames import frame

LISTED = [
    IgnoreRule("no such table", "first"),
    IgnoreRule("TABLE: dep", "second"),
    IgnoreRule("off", "switched off", enabled=False),
    IgnoreRule("^bulk.*failed$", "regex", is_regex=True),
    IgnoreRule("broken(", "does not compile", is_regex=True),
    IgnoreRule("é", "one letter"),
    IgnoreRule("x.y", "a dot is a dot"),
]
MESSAGES = [
    None, "", "SQLite: NO SUCH TABLE: Dep", "table: department", "off", "Bulk copy FAILED", "bulk failed now",
    "café", "x.y", "xzy", "no such", "\U0001F600 table: dep \U0001F600", "no such table" * 500,
]


def _errors(spark, messages):
    return frame(spark, "errors", [{"ErrorID": k, "ErrorMessage": m} for k, m in enumerate(messages)])


def _flags(df):
    return {r["ErrorID"]: (r["IsIgnored"], r["IgnoreReason"]) for r in df.collect()}


def test_a_table_of_rules_gives_what_the_list_gives(spark, tmp_path):
    errors = _errors(spark, MESSAGES * 3)
    rules.rules_table(spark, LISTED).write.parquet(f"{tmp_path}/rules")
    table = spark.read.parquet(f"{tmp_path}/rules")
    for how in ({}, {"case_sensitive": True}, {"use_regex": False}):
        got = rules.flag_errors_by_table(errors, table, **how)
        want = monitoring.flag_ignored_errors(errors, LISTED, **how)
        assert got.columns == errors.columns + ["IgnoreReason", "IsIgnored"] == want.columns
        assert _flags(got) == _flags(want) and got.count() == len(MESSAGES) * 3


def test_random_rules_and_messages(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abAB é") for _ in range(rng.randint(0, most)))
    messages = [word(30) for _ in range(400)]
    listed = [IgnoreRule(word(9) or "aa", f"rule {k}") for k in range(60)]
    got = _flags(rules.flag_errors_by_table(_errors(spark, messages), rules.rules_table(spark, listed)))
    for k, message in enumerate(messages):
        first = next((r.description for r in listed if r.pattern.lower() in message.lower()), None)
        assert got[k] == (int(first is not None), first)


def test_empty_and_null_patterns_and_tables(spark):
    errors = _errors(spark, MESSAGES)
    table = spark.createDataFrame([(2, "", "all", True, False), (1, None, "none", True, False), (1, "no s", None, True, False)], rules.RULES)
    got = _flags(rules.flag_errors_by_table(errors, table))
    assert got[0] == (0, None) and got[1] == (1, "all") and got[8] == (1, "all")
    assert {v for _, v in _flags(rules.flag_errors_by_table(errors, table.limit(0))).values()} == {None}
    assert rules.flag_errors_by_table(errors.limit(0), table).count() == 0


def test_thousands_of_rules_are_joined(spark):
    listed = [IgnoreRule(f"fault number {k} in step {k % 7}", f"rule {k}") for k in range(5000)]
    messages = [f"Fault number {k} in step {k % 7}: stopped" for k in range(0, 12_000, 3)]
    messages += ["fault number 1 in step 1 again"] * 4000  # a third of the log is one message
    df = rules.flag_errors_by_table(_errors(spark, messages), rules.rules_table(spark, listed))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = _flags(df)
    for k, message in enumerate(messages):
        number = int(message.split()[2])
        assert got[k][1] == (f"rule {number}" if number < 5000 else None)
