"""Substring search by runs of letters against a scan of the texts."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from repeatlens.functions.text import any_contains, like_pattern
from repeatlens.operators import text_index
from repeatlens.operators.text_index import TextIndex

SCHEMA = "id long, name string, town string, _text string"
TERMS = ["a", "é", "ab", "bA", "abc", "cab", "aabbc", "😀", "b😀a", "zzz", "%", "_", "a%b", "a_b", "\\", "", "ABCABC"]


def _rows(n, seed):
    r = random.Random(seed)

    def text():
        if r.random() < 0.1:
            return None
        return "".join(r.choice("aAbBc%_\\é😀 ") for _ in range(r.randrange(9)))

    return [(i if r.random() > 0.02 else None, text(), text(), "own") for i in range(n)]


def _ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def table(spark):
    return spark.createDataFrame(_rows(600, 3), SCHEMA)


@pytest.fixture
def index(spark, table, tmp_path):
    return TextIndex(spark, str(tmp_path / "index"), ["id"], ["name", "town"]).add(table)


def test_equals_a_scan(index, table):
    known = table.where("id IS NOT NULL")
    for term in TERMS:
        want = known.where(any_contains([F.col("name"), F.col("town")], term))
        found = index.search(table, term)
        assert found.columns == table.columns
        assert _ids(found) == _ids(want), term


def test_wildcards_equal_a_scan(index, table):
    known = table.where("id IS NOT NULL")
    for term in TERMS:
        holds = F.col("name").ilike(like_pattern(term)) | F.col("town").ilike(like_pattern(term))
        assert _ids(index.keys(term, wildcards=True)) == _ids(known.where(holds)), term


def test_rows_are_added_once_also_after_a_lost_driver(spark, index, table, tmp_path):
    more = spark.createDataFrame([(1000, "abcab", "new", ""), (3, "ABCAB", None, "")], SCHEMA)
    half = TextIndex(spark, index.path, ["id"], ["name", "town"])
    append, half._append = half._append, lambda df, part, order: (
        append(df, part, order) if part == "postings" else (_ for _ in ()).throw(OSError(part))
    )
    with pytest.raises(OSError):
        half.add(more)
    before = _ids(index.keys("abcab"))
    assert 1000 not in before
    for _ in range(2):
        index.add(more)
    assert _ids(index.keys("abcab")) == sorted({*before, 3, 1000})
    texts = spark.read.parquet(f"{index.path}/texts")
    assert texts.count() == texts.select("_text").distinct().count()
    carriers = spark.read.parquet(f"{index.path}/carriers")
    assert carriers.count() == carriers.distinct().count()


def test_repeated_keys_and_no_rows(spark, tmp_path):
    """A drug name is the key of all its dispenses; an empty table is an index of nothing."""
    rows = spark.createDataFrame([("Ring",)] * 50 + [("spring",), (None,), ("",)], "drug string")
    index = TextIndex(spark, str(tmp_path / "drugs"), ["drug"], ["drug"]).add(rows)
    assert spark.read.parquet(f"{index.path}/texts").count() == 3
    assert index.search(rows, "RING").count() == 51
    assert index.search(rows, "spring").count() == 1
    none = TextIndex(spark, str(tmp_path / "none"), ["drug"], ["drug"]).add(rows.limit(0))
    assert none.search(rows, "ring").count() == 0
    assert none.add(rows).search(rows, "RING").count() == 51


def test_reads_few_postings(index, table):
    """The runs reach the scan of the postings, at most three of them; an unknown one reads nothing."""
    plan = index.keys("abcabé")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(_run" in plan
    assert "BatchScan" not in plan and "CartesianProduct" not in plan
    unknown = index.keys("qqq")._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" not in unknown


def test_postings_are_sorted_files_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "TEXTS", 100)
    rows = spark.range(1000).selectExpr("id", "concat('user', id, '@example.com') AS name")
    index = TextIndex(spark, str(tmp_path / "users"), ["id"], ["name"])
    plans, append = [], index._append
    monkeypatch.setattr(index, "_append", lambda df, *to: plans.append((to[0], df)) or append(df, *to))
    index.add(rows)
    plan = dict(plans)["postings"]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [_id" in plan and "Aggregate" not in plan
    files = list((tmp_path / "users" / "postings").glob("*.parquet"))
    assert 10 <= len(files) <= 11
    for path in files:
        runs = pq.read_table(path)["_run"].to_pylist()
        assert runs == sorted(runs)
    assert _ids(index.search(rows, "USER99")) == sorted(x for x in range(1000) if str(x).startswith("99"))
