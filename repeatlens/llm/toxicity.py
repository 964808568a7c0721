"""Toxicity: a learned lexicon, matched with misspellings, weighed by context.

The lexicon (words, and beginnings of words) and all weights are learned from labelled
documents. The trie of the lexicon is intersected with Levenshtein automata of distance 1
(terms of five letters or more): states are sets of (trie node, edits), made deterministic
once into a table, so that all words of a text run through it in parallel, letter by
letter, and most die after two or three. Every hit is looked at in its context: inside
quotation marks that its line has opened, or near words of reporting, it counts as quoted,
which has weights of its own. A logistic model turns the hits of a text into a score.

Words are runs of letters, their marks, and numbers; an emoji or a variation selector ends
one. Scripts without spaces between words have long ones, of which beginnings may match.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import fold, map_arrow, settled, texts
from repeatlens.llm.words import code_points, kinds

LEAST_FUZZY = 5
REPORTING = re.compile(  # fixed values: words of reporting speech
    r"\b(?:said|says|called|calls|wrote|writes|quote[ds]?|quoting|word|term|dit|sagte|dijo)\b", re.I
)
QUOTES = '"“”„«»'
REACH = 60
ROWS = 128
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Lexicon:
    """Terms with their weights; ``begins`` marks those that match beginnings of words."""

    terms: list[str] = field(default_factory=list)
    begins: list[bool] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    fuzzy: list[float] = field(default_factory=list)


class Automaton:
    """The trie of a lexicon, intersected with automata of distance 1, as one table."""

    def __init__(self, lexicon: Lexicon):
        letters = sorted({c for t in lexicon.terms for c in t})
        # Class 0 stands for all letters outside the lexicon.
        self.classes = {c: k + 1 for k, c in enumerate(letters)}
        children: list[dict[int, int]] = [{}]
        word: dict[int, int] = {}
        begin: dict[int, int] = {}
        deepest = [0]  # by node: the longest word below that may be misspelled
        for k, (term, begins) in enumerate(zip(lexicon.terms, lexicon.begins, strict=True)):
            node, fuzzy = 0, 0 if begins else len(term)
            deepest[0] = max(deepest[0], fuzzy)
            for c in term:
                child = children[node].get(self.classes[c])
                if child is None:
                    child = children[node][self.classes[c]] = len(children)
                    children.append({})
                    deepest.append(0)
                node = child
                deepest[node] = max(deepest[node], fuzzy)
            (begin if begins else word)[node] = k
        self._children, self._word, self._deepest = children, word, deepest
        start = self._closed({(0, 0)})
        states, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        at = 0
        while at < len(order):
            rows.append([0] * (len(letters) + 1))
            for c in range(len(letters) + 1):
                to = self._step(order[at], c)
                if to not in states:
                    states[to] = len(order)
                    order.append(to)
                rows[at][c] = states[to]
            at += 1
        self.table = np.array(rows, np.int32)
        ends = [min(((e, word[n]) for n, e in s if n in word), default=(0, -1)) for s in order]
        self.end_term = np.array([k for _, k in ends], np.int32)
        self.end_edits = np.array([e for e, _ in ends], np.int32)
        begun = [max((begin[n] for n, e in s if e == 0 and n in begin), default=-1) for s in order]
        self.begin_term = np.array(begun, np.int32)
        self.class_of = np.zeros(1 << 16, np.int32)
        for c, k in self.classes.items():
            if ord(c) < len(self.class_of) - 1:
                self.class_of[ord(c)] = k

    def _closed(self, items: set) -> frozenset:
        """Adds deletions (a letter of the term left out), drops what an exact path covers."""
        out = set(items)
        for n, e in items:
            if e == 0 and self._deepest[n] >= LEAST_FUZZY:
                out |= {(m, 1) for m in self._children[n].values() if self._deepest[m] >= LEAST_FUZZY}
        return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

    def _step(self, state: frozenset, c: int) -> frozenset:
        out = set()
        for n, e in state:
            child = self._children[n].get(c)
            if child is not None and (e == 0 or self._deepest[child] >= LEAST_FUZZY):
                out.add((child, e))
            if e == 0 and self._deepest[n] >= LEAST_FUZZY:
                out.add((n, 1))  # a letter too many
                out |= {(m, 1) for k, m in self._children[n].items() if k != c and self._deepest[m] >= LEAST_FUZZY}
        return self._closed(out)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Starts, terms and edits of the hits, and the number of words."""
        points = code_points(text)
        kind = kinds(points)
        inside = kind > 0
        letter = kind == 1
        odd = np.isin(points, _SYMBOLS)
        if odd.any():  # a symbol between two letters stands for a letter
            between = np.zeros(len(points), bool)
            between[1:-1] = odd[1:-1] & letter[:-2] & letter[2:]
            inside |= between
        if not inside.any():
            none = np.empty(0, np.int64)
            return none, none, none, 0
        cls = self.class_of[np.minimum(points, 0xFFFF)]
        before = np.concatenate(([False], inside[:-1]))
        starts = np.flatnonzero(inside & ~before)
        ends = np.concatenate((~inside[1:], [True]))  # the last letter of a word
        at, origin = starts, starts
        state = np.ones(len(starts), np.int32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            state = self.table[state, cls[at]]
            live = state > 0
            at, origin, state = at[live], origin[live], state[live]
            begun = self.begin_term[state]
            hit = begun >= 0
            if hit.any():
                found.append((origin[hit], begun[hit], np.zeros(hit.sum(), np.int32)))
            over = ends[at]
            if over.any():
                term = self.end_term[state[over]]
                hit = term >= 0
                if hit.any():
                    found.append((origin[over][hit], term[hit], self.end_edits[state[over]][hit]))
                at, origin, state = at[~over], origin[~over], state[~over]
            at = at + 1
        if not found:
            none = np.empty(0, np.int64)
            return none, none, none, len(starts)
        return *(np.concatenate(x) for x in zip(*found)), len(starts)


_SYMBOLS = np.array([ord(c) for c in "@$!*+"], np.uint32)


_QUOTE = re.compile(f"[{QUOTES}]")


def quoted(text: str, places: list[int] | np.ndarray) -> np.ndarray:
    """Which of the places stand in quotation marks on their line, or near words of reporting.

    Marks, line ends and reporting words are looked up once for all places of the text.
    """
    at = np.asarray(places, np.int64)
    ends = np.array([i for i, c in _found(_LINE_END, text)], np.int64)
    marks = np.array([i for i, _ in _found(_QUOTE, text)], np.int64)
    line = np.append(0, ends + 1)[np.searchsorted(ends, at)]
    opened = (np.searchsorted(marks, at) - np.searchsorted(marks, line)) % 2 == 1
    said = np.array(_found(REPORTING, text), np.int64).reshape(-1, 2)
    first = np.searchsorted(said[:, 0], np.maximum(line, at - REACH))
    reported = first < len(said)
    reported[reported] = said[first[reported], 1] <= at[reported] + REACH
    return opened | reported


_LINE_END = re.compile("\n")


def _found(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


N_FEATURES = 7


def features(automaton: Automaton, lexicon: Lexicon, text: str) -> list[float]:
    starts, terms, edits, n = automaton.scan(text)
    sums, hits, shares = [0.0, 0.0, 0.0], 0, 0
    seen = set()
    context = quoted(text, starts) if len(starts) else starts
    for t, e, is_quoted in zip(terms.tolist(), edits.tolist(), context.tolist(), strict=True):
        hits += not is_quoted and not e
        shares += is_quoted
        if (t, e, is_quoted) not in seen:
            seen.add((t, e, is_quoted))
            weight = lexicon.fuzzy[t] if e else lexicon.weights[t]
            sums[2 if is_quoted else 1 if e else 0] += weight
    return [*(math.log1p(max(0.0, x)) for x in sums), math.log1p(hits), 100 * hits / (n + 20), math.log1p(n), float(bool(hits))]


@dataclass
class Model:
    lexicon: Lexicon
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + z @ self.beta[1:], -40, 40)))


def _term_counts(rows: DataFrame) -> DataFrame:
    """(term, begins, toxic, clean): documents of either label with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in _WORD.findall(text.lower()) if 3 <= len(w) <= 24}
                starts = {(w[:k], True) for w in words for k in range(4, min(8, len(w)))}
                counts[label].update({(w, False) for w in words} | starts)
        keys = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in part], pa.string()),
                    pa.array([k[1] for k in part], pa.bool_()),
                    pa.array([counts[1][k] for k in part], pa.int64()),
                    pa.array([counts[0][k] for k in part], pa.int64()),
                ],
                names=["term", "begins", "toxic", "clean"],
            )

    parts = map_arrow(rows.select("text", "label"), run, "term string, begins boolean, toxic long, clean long")
    return parts.groupBy("term", "begins").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _chosen(candidates: list, n_toxic: int, n_clean: int, words: int, beginnings: int) -> Lexicon:
    """The strongest words, and beginnings that say more than the words they begin."""
    lexicon = Lexicon()
    scored = sorted(
        ((r["toxic"] * odds, r, odds) for r in candidates if (odds := _odds(r["toxic"], r["clean"], n_toxic, n_clean)) > 1.2),
        key=lambda x: (-x[0], x[1]["term"]),
    )
    counts = {}
    for _, r, odds in scored:
        if not r["begins"] and odds > 2 and len(counts) < words:
            counts[r["term"]] = r["toxic"]
            lexicon.terms.append(r["term"])
            lexicon.begins.append(False)
            lexicon.weights.append(odds)
    starts: list[str] = []
    for _, r, odds in scored:
        term = r["term"]
        if not r["begins"] or len(starts) >= beginnings:
            continue
        if any(term.startswith(s) or s.startswith(term) for s in starts):
            continue
        if any(w.startswith(term) and 1.15 * n >= r["toxic"] for w, n in counts.items()):
            continue
        starts.append(term)
        lexicon.terms.append(term)
        lexicon.begins.append(True)
        lexicon.weights.append(odds)
    lexicon.fuzzy = [0.0] * len(lexicon.terms)
    return lexicon


def _mapped(rows: DataFrame, lexicon: Lexicon, make, schema: str) -> DataFrame:
    """``rows`` of (doc_id, text, ...) through make(automaton, batch of columns)."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield make(automaton, shared.value, batch.slice(at, ROWS))

    return map_arrow(rows, run, schema)


def _featured(automaton: Automaton, lexicon: Lexicon, part: pa.RecordBatch) -> pa.RecordBatch:
    x = [features(automaton, lexicon, t) for t in part.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(x, pa.list_(pa.float64())), *part.columns[2:]],
        names=["doc_id", "x", *part.schema.names[2:]],
    )


def _fuzzy_hits(automaton: Automaton, lexicon: Lexicon, part: pa.RecordBatch) -> pa.RecordBatch:
    terms, labels = [], []
    for text, label in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
        _, found, edits, _ = automaton.scan(text)
        own = set(found[edits > 0].tolist())
        terms += own
        labels += [label] * len(own)
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.int32()), pa.array(labels, pa.int32())], names=["term", "label"]
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most: int = 4000,
    words: int = 240,
    beginnings: int = 40,
    candidates: int = 5000,
) -> Model:
    """Learns from labelled rows outside fold 0: at most ``most`` of each label, those with
    the smallest hash of doc_id. Null labels, ids without a document and null ids are left
    out. Rows that repeat an id and a label count once, with the smallest text; an id with
    both labels counts for either. Without both labels the score is the share of label 1, or
    0 without labels.

    The lexicon has at most ``words`` words and ``beginnings`` beginnings of words, of 3 to 24
    letters, chosen from the ``candidates`` that say most of those in 3 toxic documents or
    more. The driver holds no more than these. The sample is written to the checkpoint folder
    once."""
    known = labels.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")
    ).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    known = settled(known.filter(fold(F.col("doc_id")) != 0).distinct())
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return Model(Lexicon(), 1.0 if totals.get(1) else 0.0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [known.filter(F.col("label") == k).orderBy(*order).limit(most) for k in (0, 1)]
    # At most 2 * most rows of 12 bytes.
    sample = F.broadcast(picked[0].union(picked[1]))
    rows = texts(docs, id_col, text_col).join(sample, "doc_id").groupBy("doc_id", "label")
    rows = settled(rows.agg(F.min("text").alias("text")).select("doc_id", "text", "label"))
    counts = _term_counts(rows).filter("toxic >= 3").orderBy(
        F.desc(F.expr("toxic * (log(toxic + 0.5) - log(clean + 0.5))")), "term"
    )
    n = {k: min(most, v) for k, v in totals.items()}
    lexicon = _chosen(counts.limit(candidates).collect(), n[1], n[0], words, beginnings)
    if not lexicon.terms:
        return Model(lexicon, totals[1] / sum(totals.values()))
    # A misspelling that neither label shows says half as much as the word itself.
    lexicon.fuzzy = [0.0 if b else w / 2 for w, b in zip(lexicon.weights, lexicon.begins, strict=True)]
    near = _mapped(rows, lexicon, _fuzzy_hits, "term int, label int")
    for r in near.groupBy("term").agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect():
        lexicon.fuzzy[r["term"]] = max(0.0, _odds(r["toxic"], r["n"] - r["toxic"], n[1], n[0]))
    schema = "doc_id long, x array<double>, label int"
    fitted = _mapped(rows, lexicon, _featured, schema).select("x", "label").collect()
    x = np.array([r["x"] for r in fitted]).reshape(-1, N_FEATURES)
    y = np.array([r["label"] for r in fitted], float)
    if len(set(y)) < 2:
        return Model(lexicon, totals[1] / sum(totals.values()))
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    return _logistic(lexicon, x, y, weight / weight.mean(), totals[1] / sum(totals.values()))


def _logistic(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float) -> Model:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], 1.0)
    ridge[0] = 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - ridge * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(lexicon, prior, mean, scale, beta)


def toxicity_scores(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and score (0 to 1) of every text. Null texts count as empty; texts without
    hits get the score of their length without hits; repeated rows are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(automaton: Automaton, lexicon: Lexicon, part: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(automaton, lexicon, t) for t in part.column(1).to_pylist()])
        score = shared.value.score(x.reshape(-1, N_FEATURES))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return _mapped(texts(docs, id_col, text_col), model.lexicon, make, "doc_id long, score double")


def without_toxic(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5
) -> DataFrame:
    """The documents, with all their columns, that score below ``limit``. Rows that repeat an
    id go together if one of them is rejected; rows with a null id stay."""
    rejected = (
        toxicity_scores(docs, model, id_col, text_col)
        .filter(F.col("score") >= limit)
        .select(F.col("doc_id").alias("__rejected"))
        .distinct()
    )
    return docs.join(rejected, F.col(f"`{id_col}`") == F.col("__rejected"), "left_anti")
