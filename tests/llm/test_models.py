"""Held-out quality of the three classifiers, and their parts against brute force."""

import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from repeatlens.llm import language_id, quality, toxicity
from tests.llm.cases import AWKWARD, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def pieces():
    known = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [known.id_to_piece(i) for i in range(known.get_piece_size())]


def _held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_quality(docs, labels):
    measured = quality.document_statistics(docs).cache()
    model = quality.fit(measured, labels)
    score = {r["doc_id"]: r["score"] for r in quality.scores(measured, model).collect()}
    held = [(score[r["doc_id"]], r["quality"]) for r in labels.collect() if _held_out(r["doc_id"])]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(a > b for a in good for b in bad) / len(good) / len(bad) > 0.95
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == docs.count()


def test_isotonic_is_monotone_and_pooled():
    knots, levels = quality._isotonic(np.arange(6.0), np.full(6, 10.0), np.array([0, 4, 2, 6, 9, 8.0]))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()
    assert levels[2] == pytest.approx(6.1 / 20.2)  # bins 1 and 2 pooled


def test_toxicity(spark):
    # The larger tables: at SF only six toxic documents are held out, here 97.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, model).collect()}
    held = [(score[r["doc_id"]] >= 0.5, r["toxic"]) for r in labels.collect() if _held_out(r["doc_id"])]
    caught = sum(p for p, t in held if t)
    assert caught >= 0.8 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)
    kept = toxicity.without_toxic(docs, model)
    assert kept.count() == sum(s < 0.5 for s in score.values()) and kept.columns == docs.columns


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
    return new


def test_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon(["abcde", "abx", "cabde", "eedcba"], [False, False, False, True], [1.0] * 4, [1.0] * 4)
    automaton, r = toxicity.Automaton(lexicon), random.Random(3)
    for _ in range(4000):
        word = "".join(r.choice("abcdexq") for _ in range(r.randint(1, 8)))
        _, terms, edits, n = automaton.scan(word)
        assert n == 1
        near = {(k, d) for k, t in enumerate(lexicon.terms[:3]) if (d := _distance(word, t)) <= (len(t) >= 5)}
        found = [(k, e) for k, e in zip(terms.tolist(), edits.tolist()) if k != 3]
        assert bool(found) == bool(near)
        assert not found or (found[0] in near and found[0][1] == min(d for _, d in near))
        assert (3 in terms.tolist()) == word.startswith("eedcba")


def test_context():
    def quoted(text, at):
        return toxicity.quoted(text, [at]).tolist() == [True]

    assert quoted('they wrote "fool" here', 12)
    assert quoted("someone called them a fool", 22)
    assert not quoted('"so it goes" you fool', 17)
    far = "blah " * 2000
    assert quoted(f'"{far}fool', len(far) + 1)  # opened 10,000 characters before
    assert not quoted(f'"{far}" {far}fool', 2 * len(far) + 3)
    assert not quoted(f'"{far}\nfool', len(far) + 2)  # another line


def test_context_against_a_search_for_every_place():
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choices(['"', "„", "said", " ", "\n", "x", "word ", "unsaid", "blah " * 5], k=40))
        places = sorted(r.sample(range(len(text)), 9))
        want = []
        for at in places:
            line = text.rfind("\n", 0, at) + 1
            near = any(
                m.start() >= max(line, at - toxicity.REACH) and m.end() <= at + toxicity.REACH
                for m in toxicity.REPORTING.finditer(text)
            )
            want.append(sum(c in toxicity.QUOTES for c in text[line:at]) % 2 == 1 or near)
        assert toxicity.quoted(text, places).tolist() == want


def test_context_takes_one_pass():
    text = '"fool" fool, you ' * 60_000  # a megabyte on one line
    lexicon = toxicity.Lexicon(["fool"], [False], [1.0], [1.0])
    began = time.process_time()
    toxicity.features(toxicity.Automaton(lexicon), lexicon, text)
    assert time.process_time() - began < 10


def test_signs_end_a_word():
    automaton = toxicity.Automaton(toxicity.Lexicon(["fool"], [False], [1.0], [1.0]))
    for text in ("fool\U0001F600", "\U0001F600\uFE0Ffool\uFE0F", "fool\u200D\u2764\uFE0F", "fool\u20E3"):
        assert automaton.scan(text)[1].tolist() == [0], text


def test_symbols_inside_words():
    automaton = toxicity.Automaton(toxicity.Lexicon(["scoundrel"], [False], [1.0], [1.0]))
    assert automaton.scan("sc*undrel, sc0undrel; scoundrel*** scondrel")[2].tolist().count(1) == 3


def test_language(docs, pieces):
    model = language_id.fit(docs, pieces)
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = language_id.predict(docs, model).collect()
    held = [r for r in got if _held_out(r["doc_id"])]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) > 0.97 * len(held)
    for word in ("the", "erheat", "ñandú", "日本", "x" * 20, "straßenbahnhaltestellen" * 5):
        total, _, _ = _by_hand(model, pieces, word, 0)
        score = language_id._sums(model.p, model.voc, ["! " + word])[0][0, 0]
        assert score == pytest.approx(math.log(total))


def _by_hand(model, pieces, word, lang):
    """The sum over all segmentations of a word into any pieces of the file, the expected
    counts of its pieces, and their numbers."""
    letters = (p for p in pieces if p and (p.removeprefix("▁") or "x").isalpha() and p == p.lower())
    known = {p: k for k, p in enumerate(sorted(set(letters)))}
    text, longest = "▁" + word, max(map(len, known))
    ahead, behind = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    edges = [
        (i, i + k, known.get(text[i : i + k], -1))
        for i in range(len(text)) for k in range(1, min(longest, len(text) - i) + 1)
        if k == 1 or text[i : i + k] in known
    ]
    for i, j, piece in edges:
        ahead[j] += ahead[i] * model.p[piece, lang]
    for i, j, piece in reversed(edges):
        behind[i] += behind[j] * model.p[piece, lang]
    counts = {}
    for i, j, piece in edges:
        if piece >= 0:
            use = ahead[i] * model.p[piece, lang] * behind[j] / ahead[-1]
            counts[piece] = counts.get(piece, 0) + use
    return ahead[-1], counts, known


def test_all_pieces_take_part(pieces):
    voc = language_id.vocabulary(pieces)
    assert voc.longest == max(len(p) for p in pieces if p.removeprefix("▁").isalpha() and p == p.lower())
    assert voc.longest > 10


def test_expected_counts(pieces):
    voc = language_id.vocabulary(pieces)
    p = language_id._normalised(np.random.default_rng(1).random((voc.size + 1, 2)))
    model = language_id.Model(["a", "b"], p, voc)
    texts = ["the there, other", "weather the", "überhaupt" * 9 + " the", "日本 the"]
    got = language_id._expected(p, voc, texts, np.array([0, 1, 1, 0]))
    want = np.zeros_like(p)
    for text, lang in zip(texts, (0, 1, 1, 0)):
        for word in text.replace(",", "").split():
            for piece, n in _by_hand(model, pieces, word, lang)[1].items():
                want[piece, lang] += n
    assert np.allclose(got, want)


def test_texts_without_letters(spark, docs, pieces):
    model = language_id.fit(docs, pieces)
    signs = ["\U0001F600", "\u2764\uFE0F", "\u0301\u0308", "1\uFE0F\u20E3", "12 ٣", "...", "\U000E0101", " "]
    letters = ["a", "日", "\U00020000", "\U0001F600 a", "e\u0301"]
    got = language_id.predict(frame(spark, list(enumerate(signs + letters))), model).collect()
    pred = [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])]
    assert pred[: len(signs)] == ["und"] * len(signs)
    assert "und" not in pred[len(signs) :]


def test_repeated_rows_do_not_multiply_the_sample(spark, pieces):
    rows = spark.createDataFrame(
        [(1, "the same words", "en")] * 40 + [(2, "les mots", "fr"), (2, "des mots", "fr"), (3, None, "de")],
        "doc_id long, text string, lang string",
    )
    once = language_id.fit(rows.dropDuplicates(), pieces)
    assert once.langs == ["en", "fr"]
    assert np.allclose(language_id.fit(rows, pieces).p, once.p)


def test_awkward_rows(spark, docs, labels, pieces):
    rows = frame(spark, AWKWARD)
    lang = {r["doc_id"]: r for r in language_id.predict(rows, language_id.fit(rows, pieces)).collect()}
    assert lang[1]["lang_pred"] == lang[4]["lang_pred"] == "und" and lang[1]["score"] == 0
    none = labels.limit(0)
    measured = quality.document_statistics(rows)
    assert {r["score"] for r in quality.scores(measured, quality.fit(measured, none)).collect()} == {0.5}
    assert {r["score"] for r in toxicity.toxicity_scores(rows, toxicity.fit(rows, none)).collect()} == {0.0}
    one = spark.createDataFrame([(3, 1, 1), (None, 0, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    assert quality.scores(measured, quality.fit(measured, one)).count() == len(AWKWARD)
    model = toxicity.fit(docs, labels)
    assert toxicity.without_toxic(rows, model).count() == len(AWKWARD)
    empty = rows.limit(0)
    assert toxicity.toxicity_scores(empty, toxicity.fit(empty, labels)).count() == 0
    assert language_id.predict(empty, language_id.fit(empty, pieces)).count() == 0
    assert quality.document_statistics(empty).count() == 0
