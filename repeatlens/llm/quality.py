"""Quality classifier: ridge regression on random Fourier features, then isotonic calibration.

Statistics of each document (lengths, character classes, repetition) are standardised and
mapped to cosines of random projections, whose inner products approximate a Gaussian
kernel. Every partition sums its part of the normal equations; the sums of the parts are of
fixed size, and one small system is solved. One fold of the training rows is kept apart, and
its pooled scores give a monotone map from ridge scores to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import fold, map_arrow, settled, texts

FEATURES = 256
WIDTH = 3.0  # of the kernel, in standard deviations
RIDGE = 1e-2
BINS = 2000
ROWS = 512
_CLASS = np.zeros(256, np.int64)  # of bytes
for _first, _last, _kind in ((48, 57, 1), (65, 90, 2), (97, 122, 3), (128, 255, 4)):
    _CLASS[_first : _last + 1] = _kind
for _byte in b" \t\r\n":
    _CLASS[_byte] = 5
_MARKS = np.frombuffer(b".,!|*$%&#?", np.uint8)
STATISTICS = 14 + len(_MARKS)


def statistics(text: str) -> list[float]:
    """Statistics of a whole text; an empty one counts as one empty line."""
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    kind = np.bincount(_CLASS, weights=counts, minlength=6) / size
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    lines = text.split("\n")
    share = counts[counts > 0] / size
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        *kind.tolist(),
        sum(map(len, words)) / n,
        distinct / n,
        np.log1p(n / max(1, distinct)),
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        float(-(share * np.log(share)).sum()),
        *np.sqrt(counts[_MARKS] / n).tolist(),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``x``, an array of ``STATISTICS`` doubles; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = [statistics(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
                )

    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, x array<double>")


@dataclass
class Model:
    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    phase: np.ndarray | None = None
    beta: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        cosines = np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.phase)
        return np.column_stack([np.ones(len(x)), cosines])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(x), self.prior)
        raw = self.mapped(x) @ self.beta
        return raw if self.knots is None else np.interp(raw, self.knots, self.levels)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows, from the sums of partitions, one row of Z'Z at a time."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = shared.value.mapped(_matrix(batch.column(0)))
                y = batch.column(1).to_numpy(zero_copy_only=False)
                total += z.T @ np.column_stack([z, y])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["k", "sums"],
        )

    parts = map_arrow(rows.select("x", "label"), run, "k int, sums array<double>")
    names = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size + 1)]
    out = np.zeros((size, size + 1))
    for r in parts.groupBy("k").agg(*names).collect():  # FEATURES + 1 rows
        out[r["k"]] = r[1:]
    return out[:, :-1], out[:, -1]


def _isotonic(score: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in ascending order of score."""
    blocks: list[list[float]] = []  # first score, last score, rows, ones
    for s, k, one in zip(score, n, ones, strict=True):
        blocks.append([s, s, k, one])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, k2, one2 = blocks.pop()
            blocks[-1][1] = last
            blocks[-1][2] += k2
            blocks[-1][3] += one2
    knots, levels = [], []
    for first, last, k, one in blocks:
        level = (one + 0.1) / (k + 0.2)
        knots += [first, last + 1e-9]
        levels += [level, level]
    return np.array(knots), np.maximum.accumulate(np.array(levels))


def fit(
    statistics_of: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", seed: int = 7
) -> Model:
    """Learns from all labelled rows outside fold 0; fold 1 calibrates. ``statistics_of`` is
    what ``document_statistics`` gives. Null labels, null ids and ids without a document are
    left out, repeated labels count each. Without both labels the score is the share of
    label 1, or 0.5 without labels."""
    known = labels.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("double").alias("label")
    ).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    rows = statistics_of.join(known, "doc_id").select("x", "label", fold(F.col("doc_id")).alias("fold"))
    rows = settled(rows.filter("fold != 0"))
    moments = []
    for i in range(STATISTICS):
        x = F.get("x", F.lit(i))
        moments += [F.avg(x), F.stddev_pop(x)]
    first = rows.agg(F.count(F.lit(1)), F.sum("label"), *moments).first()
    n, ones = first[0], first[1] or 0
    if n == 0 or ones in (0, n):
        return Model(ones / n if n else 0.5)
    random = np.random.default_rng(seed)
    model = Model(
        ones / n,
        np.array(first[2::2], float),
        np.array(first[3::2], float) + 1e-9,
        random.normal(size=(STATISTICS, FEATURES)) / WIDTH,
        random.uniform(0, 2 * np.pi, FEATURES),
    )
    zz, zy = _summed(rows.filter("fold != 1"), model)
    ridge = np.eye(len(zz)) * (RIDGE + 1e-9 * np.trace(zz))
    ridge[0, 0] = 0.0
    model.beta = np.linalg.solve(zz + ridge + 1e-9 * np.eye(len(zz)), zy)
    scored = scores(rows.filter("fold = 1").select(F.lit(0).cast("long").alias("doc_id"), "x", "label"), model, "label")
    at = F.floor((F.least(F.greatest("score", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2))
    bins = scored.groupBy(at.alias("bin")).agg(
        F.avg("score").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("kept").alias("ones")
    )
    found = sorted(bins.collect(), key=lambda r: r["bin"])  # at most BINS + 1 rows
    if found:
        model.knots, model.levels = _isotonic(*(np.array([r[c] for r in found], float) for c in ("s", "n", "ones")))
    else:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scores(statistics_of: DataFrame, model: Model, keep: str | None = None) -> DataFrame:
    """doc_id and score of rows with statistics; ``keep`` names a column of doubles that is
    passed on as ``kept``."""
    shared = statistics_of.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                score = shared.value.score(_matrix(part.column(1)))
                names = ["doc_id", "score", "kept"][: 2 + (keep is not None)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(score, pa.float64()), *part.columns[2:]], names=names
                )

    columns = ["doc_id", "x"] + ([keep] if keep else [])
    schema = "doc_id long, score double" + (", kept double" if keep else "")
    return map_arrow(statistics_of.select(*columns), run, schema)
