"""Pages from a stored index against slices of the sorted rows."""

import random

import pytest

from repeatlens.operators.paging import PageIndex

SCHEMA = "name string, n int, id long, _size int"


def _rows(n, seed=1):
    r = random.Random(seed)
    return [(r.choice(["a", "B", "ü", "", None]), r.choice([1, 2, 3, None]), i, 0) for i in range(n)]


def _ordered(rows):
    """By name descending, nulls last, then n, nulls first, then id."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    return rows


@pytest.fixture
def index(spark, conf, tmp_path):
    conf(shuffle__partitions="16", adaptive__coalescePartitions__enabled="false")
    df = spark.createDataFrame(random.Random(2).sample(_rows(700), 700), SCHEMA)
    return PageIndex(spark, str(tmp_path / "index"), ["-name", "n", "id"]).build(df)


def test_every_page(index):
    rows = _ordered(_rows(700))
    for page, size in [(1, 20), (2, 20), (35, 20), (36, 20), (1, 1), (700, 1), (701, 1), (3, 300), (1, 5000)]:
        got = [tuple(r) for r in index.page(page, size).collect()]
        assert got == rows[(page - 1) * size : page * size]
    with pytest.raises(ValueError):
        index.page(0)


def test_rows_behind_a_row(index):
    rows = _ordered(_rows(700))
    names = ("name", "n", "id")
    for at, size in [(0, 20), (19, 7), (350, 500), (698, 5), (699, 5)]:
        key = dict(zip(names, rows[at]))
        assert [tuple(r) for r in index.after(key, size).collect()] == rows[at + 1 : at + 1 + size]
    assert [tuple(r) for r in index.after(None, 3).collect()] == rows[:3]
    # A row that is not there any more.
    gone = {"name": "B", "n": 2, "id": 10**6}
    behind = [r for r in rows if _ordered([("B", 2, 10**6, 0), r])[1] == r]
    assert [tuple(r) for r in index.after(gone, 9).collect()] == behind[:9]


def test_a_late_page_reads_its_slice_only(spark, index, tmp_path):
    slices = spark.read.parquet(str(tmp_path / "index" / "slices"))
    assert slices.count() > 8
    page = index.page(30, 20)
    where = slices.where("_first < 600 AND _first + _size > 580")
    assert where.count() <= 2  # of all slices
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in plan and "Limit" not in plan


def test_no_rows(spark, tmp_path):
    index = PageIndex(spark, str(tmp_path / "none"), ["id"]).build(spark.createDataFrame([], SCHEMA))
    assert index.page(1).collect() == [] and index.after({"id": 1}).collect() == []
