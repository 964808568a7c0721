import random
import re
from collections import Counter

import pytest

from repeatlens.llm import licenses
from repeatlens.llm.licenses import NOTICES, PHRASES, TEMPLATES, Template
from tests.llm.cases import AWKWARD, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _expected(text, templates):
    """The digest by comparing every template with every block of every text."""
    words, places, base, labels, score = _words(text), [], set(), set(), 0.0
    for t in templates:
        run = t.text.split()
        step = 4
        while step < len(run):
            step *= 2
        for start in range(0, len(words), step):
            block = words[start : start + 2 * step]
            common = len(set(run) & set(block))
            if common < t.share * len(set(run)) - 1e-9:
                continue
            if t.phrase:
                at = [start + p for p in range(step) if block[p : p + len(run)] == run]
                if not at:
                    continue
                places += at
                base.add(t.label)
            labels.add(t.label)
            score = max(score, common / len(set(run)))
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score)


def _texts(seed, n=250):
    """Texts around the templates: whole, with words changed, dropped, put in and moved."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [rng.choice(["lorem", "the", "license", "Éa", "by", "all", "7"]) for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            run = rng.choice(TEMPLATES).text.split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(run))
                run[at : at + rng.randrange(2)] = rng.choice([["x"], [], ["y", "z"], [run[0]]])
            words[rng.randrange(len(words) + 1) :] += run
        gaps = [rng.choice([" ", "  ", "\n", ", ", "-", ".\n\n"]) for _ in words]
        out.append("".join(w if rng.random() < 0.7 else w.upper() for p in zip(words, gaps) for w in p))
    return out


@pytest.mark.parametrize("templates", [TEMPLATES, PHRASES, NOTICES, (Template("one", "x"),)])
def test_against_every_block(spark, templates):
    rows = [*AWKWARD, *enumerate(_texts(5), 100), (900, "CC BY cc by" * 3000), (901, "ALL rights\0reserved")]
    got = licenses.license_digests(frame(spark, rows), templates)
    assert got.columns == [
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    ]
    assert Counter(map(tuple, got.collect())) == Counter((i, *_expected(t, templates)) for i, t in rows)


def test_base_places_are_all_places(spark):
    """Independent of blocks: a regular search over the words."""
    rows = list(enumerate(_texts(11)))
    got = {r["doc_id"]: r for r in licenses.license_digests(frame(spark, rows)).collect()}
    for i, text in rows:
        words = _words(text)
        at = [
            k for t in PHRASES for k in range(len(words))
            if words[k : k + len(t.text.split())] == t.text.split()
        ]
        assert got[i]["n_base"] == len(at)
        assert (got[i]["first_word"], got[i]["last_word"]) == (min(at, default=None), max(at, default=None))


def test_a_notice_is_found_wherever_it_begins_and_as_80_per_cent(spark):
    notice = NOTICES[-1].text.split()  # no warranty
    rows = [(k, " ".join(["pad"] * k + notice)) for k in range(70)]
    gaps = [w for i, w in enumerate(notice) if i % 6]  # still 80 per cent
    rows += [(100, " ".join(gaps)), (101, " ".join(notice[: len(notice) // 2]))]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_digests(frame(spark, rows)).collect()}
    assert [i for i, found in got.items() if found != "no-warranty"] == [101]


def test_blocks_name_the_place(spark):
    text = "x " * 9 + "Released under the MIT License. All rights reserved"
    found = licenses.license_blocks(frame(spark, [(1, text)])).filter("label IS NOT NULL").collect()
    assert {(r["label"], r["start"], tuple(r["places"] or ())) for r in found} == {
        ("mit", 0, ()), ("mit", 8, ()), ("reserved", 12, (14,))  # blocks of 16 and 8 words
    }


def test_no_rows(spark):
    assert licenses.license_digests(frame(spark, AWKWARD).limit(0)).count() == 0
