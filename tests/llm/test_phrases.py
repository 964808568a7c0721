import random
import re
from collections import Counter

import numpy as np
import pytest

from repeatlens.llm import phrases
from tests.llm.cases import AWKWARD

SCHEMA = "doc_id long, text string, lang string, phrase string, a int, score string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, "y") for i, (t, g) in enumerate(rows)], SCHEMA)


def _runs(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def _expected(rows, least=30, top=2000):
    counts, totals = _runs(rows)
    found = {}
    frequent = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    for (lang, words), a in frequent.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        inside = any(
            g == lang and len(longer) > len(words) and 100 * f >= 80 * a
            and any(longer[i : i + len(words)] == words for i in range(len(longer)))
            for (g, longer), f in frequent.items()
        )
        if not inside:
            score, _, left, right = min(cuts)
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -score)
        for lang, members in found.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(members)[:top], 1)
    }


def _rows(seed, n=400):
    rng = random.Random(seed)
    words = ["a", "B", "c'", "Éa", "日本", "\U0001F600", " x", "d\0", "long-word"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(25)):
            text += rng.choice(words[: rng.choice([2, 4, 9])]) + rng.choice([" ", " ", "\t ", ", ", "\n", "\x0b", "."])
        out.append((text, rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return out


@pytest.mark.parametrize("least", [30, 3])
def test_against_plain_counting(spark, least, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 512)
    rows = [*_rows(3), *((t, "en") for _, t in AWKWARD), ("of the " * 5000, "en"), (None, None)]
    got = phrases.collocations(_frame(spark, rows).repartition(7), least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    out = [tuple(r) for r in got.collect()]
    assert len(out) == len(set(out)) and set(out) == _expected(rows, least)


def test_ranks_are_cut_per_language(spark):
    rows = _rows(8, 800)
    got = phrases.collocations(_frame(spark, rows), least=2, top=7).collect()
    assert {tuple(r) for r in got} == _expected(rows, 2, 7)


def test_empty_tables_and_texts(spark):
    assert phrases.collocations(_frame(spark, [])).count() == 0
    assert phrases.collocations(_frame(spark, [(None, None), ("", "en"), (".,;", "en")])).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    """Runs that pass the filter by chance are counted and fall to the least count."""
    rows = _rows(4)
    want = {tuple(r) for r in phrases.run_counts(_frame(spark, rows), 20).collect()}
    monkeypatch.setattr(
        phrases, "frequent_filter", lambda *a, **b: np.full((1 << phrases.FILTER_BITS) >> 3, 255, np.uint8)
    )
    assert {tuple(r) for r in phrases.run_counts(_frame(spark, rows), 20).collect()} == want


@pytest.mark.parametrize("seed", range(20))
def test_summaries_keep_every_frequent_key(seed):
    """However the counts are split and merged, all that is subtracted stays below ``least``."""
    rng = np.random.default_rng(seed)
    least, keys = int(rng.integers(2, 40)), rng.zipf(1.3, 20_000) % 5_000
    mass = len(keys)
    true = np.bincount(keys, minlength=5_000)
    summary = (np.empty(0, np.uint32), np.empty(0, np.int64), 0)
    for part in np.array_split(keys.astype(np.uint32), rng.integers(1, 60)):
        summary = phrases.merged(summary, *phrases.summed(part, np.ones(len(part), np.int64)), mass // least + 1)
    held, counts, off = summary
    assert off < least and len(held) <= mass // least + 1
    assert set(np.flatnonzero(true >= least)) <= set(held[counts + off >= least])
    assert all(true[k] - off <= c <= true[k] for k, c in zip(held, counts, strict=True))


def test_the_filter_is_small_beside_the_runs(spark):
    """Rare runs do not set bits: the summaries subtract them."""
    rng = random.Random(1)
    rare = [(" ".join(str(rng.random()) for _ in range(200)), "en") for _ in range(300)]
    rows = phrases.DataFrame.select(_frame(spark, [*rare, *[("very often", "en")] * 40]), "lang", "text")
    bits = phrases.frequent_filter(rows, 30)
    assert 3 <= int(np.unpackbits(bits).sum()) < 30
