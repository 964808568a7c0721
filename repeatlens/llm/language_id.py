"""Language identification by segmentation-marginalised unigrams.

Every language has a distribution over the pieces of one fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces, which a forward
pass adds up; a text's score for a language is the sum of the log probabilities of its
words. The distributions are learned by expectation-maximisation: forward and backward
passes over the training texts give expected counts of pieces, summed by partition.

Words are runs of letters, in lower case, marked at their start. All words of up to ``GRID``
letters of a block of texts pass through the recursion together; longer ones pass through
it one by one, in logarithms. Every piece of letters of the vocabulary takes part, however
long it is, and no word is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import fold, map_arrow, settled, texts
from repeatlens.llm.words import code_points, kinds, letters

GRID = 32
ROUNDS = 3
ROWS = 256
_MARK = 0x2581
_NONE, _BEGIN = -2, -1  # no piece; only the beginning of pieces
_U = np.uint64


@dataclass
class Vocabulary:
    """Pieces and their beginnings in a hash table with linear probing."""

    keys: np.ndarray  # two arrays of slots: hash, and piece number or _BEGIN
    numbers: np.ndarray
    size: int
    longest: int


def _hash_step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    h = (h ^ points.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def vocabulary(pieces: list[str]) -> Vocabulary:
    """Numbers the pieces that consist of letters in lower case, at most one mark before."""
    fit = sorted(
        {p for p in pieces if p and (p.removeprefix(chr(_MARK)) or "x").isalpha() and p == p.lower()}
    )
    held = {p[:k]: _BEGIN for p in fit for k in range(1, len(p))} | {p: k for k, p in enumerate(fit)}
    slots = 1 << (4 * len(held) + 1).bit_length()
    keys, numbers = np.zeros(slots, np.uint64), np.full(slots, _NONE, np.int32)
    for piece, number in held.items():
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = _hash_step(h, np.array([ord(c)]))
        slot = int(h[0]) % slots
        while numbers[slot] != _NONE:
            slot = (slot + 1) % slots
        keys[slot], numbers[slot] = h[0], number
    return Vocabulary(keys, numbers, len(fit), max(map(len, fit), default=0))


def _find(voc: Vocabulary, h: np.ndarray) -> np.ndarray:
    """Piece numbers of hashes, ``_BEGIN`` and ``_NONE``."""
    last = len(voc.keys) - 1
    slot = (h & _U(last)).astype(np.int64)
    out = np.full(len(h), _NONE, np.int32)
    at = np.arange(len(h))
    while len(at):
        number = voc.numbers[slot]
        same = voc.keys[slot] == h[at]
        hit = (number != _NONE) & same
        out[at[hit]] = number[hit]
        more = (number != _NONE) & ~same
        at, slot = at[more], (slot[more] + 1) & last
    return out


@dataclass
class Words:
    """The words of some texts. Those of up to ``GRID`` letters: rows of code points with the
    mark in front (0 beyond the end), longest first, each distinct word once; their sizes with
    the mark; and for each occurrence its text and row. Longer ones: text and code points."""

    grid: np.ndarray
    size: np.ndarray
    which: np.ndarray
    row: np.ndarray
    long: list[tuple[int, np.ndarray]]
    n_letters: np.ndarray  # by text


def words_of(text_list: list[str]) -> Words:
    points = code_points("\n".join(t.replace("\n", " ") for t in text_list))
    which = np.cumsum(points == 10)
    n_letters = np.bincount(which[letters(points)], minlength=len(text_list))
    inside = kinds(points) == 1
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    size = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1 - starts
    beyond = np.flatnonzero(size > GRID)
    long = [
        (int(which[starts[w]]), np.append(_MARK, points[starts[w] : starts[w] + size[w]])) for w in beyond
    ]
    starts, size = np.delete(starts, beyond), np.delete(size, beyond)
    owner = which[starts]
    order = np.argsort(-size, kind="stable")
    starts, size, owner = starts[order], size[order], owner[order]
    grid = np.zeros((len(starts), GRID + 1), np.uint32)
    grid[:, 0] = _MARK
    h = np.zeros(len(starts), np.uint64)
    for k in range(int(size.max()) if len(size) else 0):
        n = np.searchsorted(-size, -k)  # words of more than k letters
        grid[:n, k + 1] = points[starts[:n] + k]
        h[:n] = _hash_step(h[:n], grid[:n, k + 1])
    _, first, row = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    first = first[order]
    return Words(grid[first], size[first] + 1, owner, place[row], long, n_letters)


Found = list[list[tuple[int, np.ndarray, np.ndarray]]]


def _pieces(voc: Vocabulary, grid: np.ndarray, size: np.ndarray) -> Found:
    """found[i]: (k, rows, numbers) of the pieces of k letters that start at letter i. A single
    letter that is no piece has a negative number. Longest words first."""
    found: Found = []
    for i in range(int(size[0]) if len(size) else 0):
        rows = np.arange(np.searchsorted(-size, -i))
        h, row = np.zeros(len(rows), np.uint64), []
        for k in range(1, min(voc.longest, grid.shape[1] - i) + 1):
            n = np.searchsorted(-size[rows], 1 - i - k)  # words of i + k letters and more
            rows, h = rows[:n], _hash_step(h[:n], grid[rows[:n], i + k - 1])
            number = _find(voc, h)
            if k == 1:
                row.append((1, rows, number))
            elif (hit := number >= 0).any():
                row.append((k, rows[hit], number[hit]))
            alive = number != _NONE
            rows, h = rows[alive], h[alive]
            if not len(rows):
                break
        if not row:  # an empty vocabulary
            row.append((1, rows, np.full(len(rows), _NONE, np.int32)))
        found.append(row)
    return found


def _chance(p: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Probabilities by language of pieces; letters that are no piece have the last row."""
    return p[np.maximum(number, -1)]


def forward(p: np.ndarray, found: Found, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """alpha[i]: by word and language, the sum over all segmentations of the first i letters;
    and the sum over those of the whole word.

    ``p`` has a row for each piece and a last row with the floor of unknown letters.
    """
    shape = (len(size), p.shape[1])
    alpha = [np.ones(shape)] + [np.zeros(shape) for _ in found]
    for i, row in enumerate(found):
        for k, rows, number in row:
            alpha[i + k][rows] += alpha[i][rows] * _chance(p, number)
    total = np.ones(shape)
    for i in range(1, len(alpha)):
        at = size == i
        total[at] = alpha[i][at]
    return alpha, total


def _edges(voc: Vocabulary, points: np.ndarray) -> list[tuple[int, int, int]]:
    """(i, j, number) of the pieces of one word, and of its letters that are no piece."""
    n, edges = len(points), []
    for at in range(0, n, 4096):
        i = np.arange(at, min(n, at + 4096))
        h = np.zeros(len(i), np.uint64)
        for k in range(1, max(voc.longest, 1) + 1):
            fits = i + k <= n
            i, h = i[fits], h[fits]
            if not len(i):
                break
            h = _hash_step(h, points[i + k - 1])
            number = _find(voc, h)
            hit = number >= 0 if k > 1 else np.ones(len(i), bool)
            edges += zip(i[hit].tolist(), (i[hit] + k).tolist(), np.maximum(number[hit], -1).tolist(), strict=True)
            alive = number != _NONE
            i, h = i[alive], h[alive]
    return sorted(edges)


def _log_forward(log_p: np.ndarray, edges: list, n: int) -> np.ndarray:
    """Logarithms of alpha for one word of n letters."""
    alpha = np.full((n + 1, log_p.shape[1]), -np.inf)
    alpha[0] = 0.0
    for i, j, number in edges:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + log_p[number])
    return alpha


def _sums(p: np.ndarray, voc: Vocabulary, text_list: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability by text and language, and letters by text."""
    n, langs = len(text_list), p.shape[1]
    words, scores = words_of(text_list), np.zeros((len(text_list), p.shape[1]))
    if len(words.size):
        _, total = forward(p, _pieces(voc, words.grid, words.size), words.size)
        log = np.log(total)[words.row]
        scores += np.stack([np.bincount(words.which, weights=log[:, k], minlength=n) for k in range(langs)], 1)
    log_p = np.log(p) if words.long else p
    for text, points in words.long:
        scores[text] += _log_forward(log_p, _edges(voc, points), len(points))[-1]
    return scores, words.n_letters


def _expected(p: np.ndarray, voc: Vocabulary, text_list: list[str], lang: np.ndarray) -> np.ndarray:
    """Expected counts of pieces, by piece and language."""
    counts = np.zeros_like(p)
    words = words_of(text_list)
    size, langs = words.size, p.shape[1]
    if len(size):
        times = np.zeros((len(size), langs))
        np.add.at(times, (words.row, lang[words.which]), 1.0)
        found = _pieces(voc, words.grid, size)
        alpha, total = forward(p, found, size)
        share = times / total
        beta = [np.zeros((len(size), langs)) for _ in range(len(found) + 1)]
        for i in range(len(found), -1, -1):
            beta[i][size == i] = 1.0
            for k, rows, number in found[i] if i < len(found) else ():
                through = _chance(p, number) * beta[i + k][rows]
                beta[i][rows] += through
                use = alpha[i][rows] * through * share[rows]
                known = np.flatnonzero((number >= 0) & (use.max(1) > 0))
                for c in range(langs):
                    counts[:, c] += np.bincount(number[known], weights=use[known, c], minlength=len(p))
    log_p = np.log(p) if words.long else p
    for text, points in words.long:
        c, edges = lang[text], _edges(voc, points)
        own = log_p[:, c : c + 1]
        alpha = _log_forward(own, edges, len(points))[:, 0]
        beta = np.full(len(points) + 1, -np.inf)
        beta[-1] = 0.0
        for i, j, number in reversed(edges):
            through = own[number, 0] + beta[j]
            beta[i] = np.logaddexp(beta[i], through)
            if number >= 0:
                counts[number, c] += np.exp(alpha[i] + through - alpha[-1])
    return counts


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray
    voc: Vocabulary


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Smoothed distributions, with the floor of unknown letters in the last row."""
    p = counts + 0.01
    p[-1] = 0.0
    p = p / p.sum(0)
    p[-1] = 1e-7
    return p


def fit(
    docs: DataFrame,
    pieces: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most: int = 2000,
) -> Model:
    """Learns from texts with a language outside fold 0: at most ``most`` of each language,
    those with the smallest hash of doc_id. Null languages, texts and ids are left out. Rows
    that repeat an id and a language count once, with the smallest text. The sample is
    written to the checkpoint folder once and read in each of the rounds."""
    known = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{text_col}`").alias("text"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
    ).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    known = known.filter(fold(F.col("doc_id")) != 0)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.select("doc_id", "lang").distinct().withColumn("nth", F.row_number().over(order))
    # At most ``most`` rows a language, of an id and a short name.
    picked = F.broadcast(settled(picked.filter(F.col("nth") <= most).drop("nth")))
    sample = known.join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    sample = settled(sample.select("text", "lang"))
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    voc = vocabulary(pieces)
    if not langs:
        return Model([], np.ones((voc.size + 1, 0)), voc)
    p = _normalised(np.ones((voc.size + 1, len(langs))))
    for _ in range(ROUNDS):
        p = _normalised(_summed(sample, Model(langs, p, voc)))
    return Model(langs, p, voc)


def _summed(sample: DataFrame, model: Model) -> np.ndarray:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        place = {lang: k for k, lang in enumerate(model.langs)}
        counts = np.zeros_like(model.p)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lang = np.array([place[x] for x in part.column(1).to_pylist()])
                counts += _expected(model.p, model.voc, part.column(0).to_pylist(), lang)
        piece, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(counts[piece, lang], pa.float64())],
            names=["piece", "lang", "n"],
        )

    out = np.zeros_like(model.p)
    sums = map_arrow(sample, run, "piece int, lang int, n double").groupBy("piece", "lang")
    # At most one row for each piece of the vocabulary and language.
    for r in sums.agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["piece"], r["lang"]] = r["n"]
    return out


def predict(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred and score, the posterior probability of that language under equal
    priors. Null texts, texts without letters, and all texts if nothing was learned, are
    ``und`` with score 0; ties go to the first language by name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                text_list = part.column(1).to_pylist()
                names, best = ["und"] * len(text_list), np.zeros(len(text_list))
                if model.langs:
                    scores, n_letters = _sums(model.p, model.voc, text_list)
                    chance = np.exp(scores - scores.max(1, keepdims=True))
                    chance /= chance.sum(1, keepdims=True)
                    top = scores.argmax(1)
                    some = n_letters > 0
                    names = [model.langs[t] if s else "und" for t, s in zip(top, some, strict=True)]
                    best = np.where(some, chance[np.arange(len(top)), top], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    schema = "doc_id long, lang_pred string, score double"
    return map_arrow(texts(docs, id_col, text_col), run, schema)
