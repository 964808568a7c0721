import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from repeatlens.llm import common, near_dups
from repeatlens.llm.components import connected_components
from tests.llm.cases import AWKWARD, frame


def _set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set()


def _components(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _brute(rows, k):
    sets = {i: _set(t, k) for i, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(sets), 2)
        if (sets[a] or sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    comps = _components(links, sets)
    return {i: (len(sets[i]), comps[i], comps[i] == i) for i in sets}


def _edited(words, r, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.random()}"
    return " ".join(words)


def test_equals_brute_force(spark):
    r = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.collect()]
    rows += [(1000 + i, t) for i, t in AWKWARD if i not in (None, 3)]
    for g in range(4):  # groups of edited copies around the limit
        base = [f"g{g}w{r.randrange(500)}" for _ in range(120)]
        rows += [(2000 + 100 * g + k, _edited(base, r, r.randrange(9))) for k in range(40)]
    for k in (4, 5):
        got = near_dups.near_duplicates(frame(spark, rows), shingle=k).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in got} == _brute(rows, k)


def test_awkward_rows(spark):
    got = near_dups.near_duplicates(frame(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[None]["kept"] and by_id[None]["component_id"] is None
    assert by_id[1]["n_shingles"] == by_id[4]["n_shingles"] == 0
    assert all(r["kept"] for r in got)
    assert near_dups.near_duplicates(frame(spark, AWKWARD).limit(0)).count() == 0


def test_sketches_fill_and_concentrate():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 300, 5000):
        assert (near_dups.sketch(r.integers(0, 1 << 63, n).astype(np.uint64)) != 0).all()
    errors = []
    for _ in range(40):
        x = r.integers(0, 1 << 63, 300).astype(np.uint64)
        y = x.copy()
        y[:34] = r.integers(0, 1 << 63, 34).astype(np.uint64)
        same = (near_dups.sketch(x) == near_dups.sketch(y)).mean()
        errors.append(same - 266 / 334)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(400), 1000 + r.randrange(400)) for _ in range(300)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = {x["id"]: x["component"] for x in connected_components(edges).collect()}
    want = _components([p for p in pairs if p[0] != p[1]], {i for p in pairs if p[0] != p[1] for i in p})
    assert got == want
    assert connected_components(edges.filter(F.lit(False))).count() == 0


def test_stars_take_no_round_and_few_edges_few_tasks(spark, monkeypatch):
    stored, dealt = common.stored, []
    monkeypatch.setattr(common, "stored", lambda df: dealt.append(df) or stored(df))
    stars = spark.createDataFrame([(a, 10 * a + k) for a in range(1, 9) for k in range(5)], "a long, b long")
    got = {x["id"]: x["component"] for x in connected_components(stars).collect()}
    assert got == {10 * a + k: a for a in range(1, 9) for k in range(5)} | {a: a for a in range(1, 9)}
    assert len(dealt) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long").repartition(16)
    assert {x["component"] for x in connected_components(path).collect()} == {0}
    # A round reads its few edges in one task, and no edge twice.
    for df in dealt[2:]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 1, false" in plan and "Union" not in plan
