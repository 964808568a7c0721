"""Line dedup by content-defined chunks.

Lines are hashed; a rolling hash over two neighbouring line hashes ends a chunk at about
every second line, but not before it has two lines that are not blank. So boundaries depend
on the lines around them and shift with inserted or deleted lines. A line of 50 words or more is a passage by itself and forms its own chunk.
Besides, every shortest run of lines that reaches 50 words is compared, from each line on and
up to each line, wherever the chunks around it end. These runs cover each line of a longer one.
Chunks and passages are compared across all documents:
equal 128-bit digests propose, equal bytes decide. The first occurrence, by doc_id and then
line, stays; the others go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, settled, texts

WINDOW = 2
DIVISOR = 2
PASSAGE_WORDS = 50
ROWS = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def chunks(lines: list[str]) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, digest) of the chunks and passages that are compared,
    without those that overlap the first equal one of the same lines."""
    out, first = [], {}
    for a, b, digest in _compared(lines):
        if a == first.setdefault(digest, (a, b))[0] or a >= first[digest][1]:
            out.append((a, b, digest))
    return out


def _compared(lines: list[str]) -> list[tuple[int, int, bytes]]:
    n = len(lines)
    data = [line.encode() for line in lines]
    words = np.fromiter((len(line.split()) for line in lines), np.int64, n)
    found = sorted({*_defined(data, words), *_passages(words)})
    whole = memoryview(b"\n".join(data))
    at = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data]))).tolist()
    return [(a, b, xxhash.xxh3_128_digest(whole[at[a] : at[b] - 1])) for a, b in found]


def _passages(words: np.ndarray) -> list[tuple[int, int]]:
    """The shortest runs that reach ``PASSAGE_WORDS``, from each line on and up to each line;
    none starts or ends with a blank line."""
    n, total = len(words), np.concatenate(([0], np.cumsum(words)))
    some = np.flatnonzero(words)
    to = np.searchsorted(total, total[some] + PASSAGE_WORDS)
    since = np.searchsorted(total, total[some + 1] - PASSAGE_WORDS, "right") - 1
    onward, upward = to <= n, since >= 0
    return [
        *zip(some[onward].tolist(), to[onward].tolist(), strict=True),
        *zip(since[upward].tolist(), (some[upward] + 1).tolist(), strict=True),
    ]


def _defined(data: list[bytes], words: np.ndarray) -> list[tuple[int, int]]:
    """The content-defined chunks."""
    n = len(data)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, n)
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        rolling[WINDOW - 1 :] = rolling[WINDOW - 1 :] * _BASE + h[k : n - WINDOW + 1 + k]
    rolling ^= rolling >> np.uint64(29)
    ends = (rolling * _BASE >> np.uint64(32)) % np.uint64(DIVISOR) == 0
    ends[: WINDOW - 1] = False
    found, a, filled = [], 0, 0

    def close(b: int) -> None:
        if filled > 1 or (filled and words[a] >= PASSAGE_WORDS):
            found.append((a, b))

    for i, (end, count) in enumerate(zip(ends.tolist(), words.tolist(), strict=True)):
        if count >= PASSAGE_WORDS:  # a chunk of its own
            close(i)
            a, filled = i, 1
            close(i + 1)
            a, filled = i + 1, 0
            continue
        filled += count > 0
        if end and filled > 1:  # no chunk of a single short line
            close(i + 1)
            a, filled = i + 1, 0
    close(n)
    return found


def _occurrences(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, first, last, digests = [], [], [], []
                for i, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for a, b, digest in _compared(text.split("\n")):
                        ids.append(i)
                        first.append(a)
                        last.append(b)
                        digests.append(digest)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(digests, pa.binary())],
                    names=["doc_id", "a", "b", "digest"],
                )

    return map_arrow(docs, run, "doc_id long, a int, b int, digest binary")


def _chunk_bytes(docs: DataFrame) -> DataFrame:
    """The bytes of the chunks that each row lists in ``spots``, compressed for the way:
    the same bytes always give the same result, and other bytes another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = []
                part = batch.slice(at, ROWS)
                for i, text, spots in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    lines = text.split("\n")
                    rows += [
                        (s["digest"], i, s["a"], s["b"], s["first"], zlib.compress("\n".join(lines[s["a"] : s["b"]]).encode(), 1))
                        for s in spots
                    ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[k] for r in rows], t)
                        for k, t in enumerate((pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))
                    ],
                    names=["digest", "doc_id", "a", "b", "first", "bytes"],
                )

    schema = "digest binary, doc_id long, a int, b int, first boolean, bytes binary"
    return map_arrow(docs.select("doc_id", "text", "spots"), run, schema)


def _cover(spots: list[dict]) -> list[dict]:
    """As few of the spots as cover the same lines as all of them."""
    spots = sorted(spots, key=lambda s: (s["a"], -s["b"]))
    out, end, k = [], 0, 0
    while k < len(spots):
        best = None
        while k < len(spots) and spots[k]["a"] <= end:
            if best is None or spots[k]["b"] > best["b"]:
                best = spots[k]
            k += 1
        if best is not None and best["b"] > end:
            out.append(best)
            end = best["b"]
        elif k < len(spots):
            end = spots[k]["a"]
    return out


_SPOT = "a int, b int, digest binary, top_id long, top_a int, top_b int"


def _covering(by_doc: DataFrame) -> DataFrame:
    """(doc_id, spot) of the spots that ``_cover`` picks from each row's ``spots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, picked = [], []
                for i, spots in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    cover = _cover(spots)
                    ids += [i] * len(cover)
                    picked += cover
                kind = part.schema.field(1).type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(picked, kind)], names=["doc_id", "spot"])

    return map_arrow(by_doc, run, f"doc_id long, spot struct<{_SPOT.replace(' ', ':').replace(',:', ',')}>")


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``gone``, an array of (a, b): the line ranges to remove from it.

    What overlaps its first occurrence, in lines that repeat each other, is no repeat of it.
    """
    rows = texts(docs, id_col, text_col).filter("doc_id IS NOT NULL AND text != ''")
    occurrences = _occurrences(rows)  # computed twice, which is less than storing them
    repeated = settled(
        occurrences.groupBy("digest")
        .agg(F.min(F.struct("doc_id", "a", "b")).alias("top"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "top.doc_id", "top.a", "top.b")
        .toDF("digest", "top_id", "top_a", "top_b")
    )
    repeats = occurrences.join(repeated, "digest").filter("NOT (doc_id = top_id AND a < top_b)")
    spot = F.struct("a", "b", "digest", "top_id", "top_a", "top_b")
    chosen = settled(
        _covering(repeats.groupBy("doc_id").agg(F.collect_list(spot).alias("spots"))).select("doc_id", "spot.*")
    )
    firsts = chosen.select(
        F.col("top_id").alias("doc_id"), F.col("top_a").alias("a"), F.col("top_b").alias("b"), "digest"
    ).distinct()
    spots = chosen.select("doc_id", "a", "b", "digest", F.lit(False).alias("first")).union(
        firsts.withColumn("first", F.lit(True))
    )
    by_doc = spots.groupBy("doc_id").agg(
        F.collect_list(F.struct("a", "b", "digest", "first")).alias("spots")
    )
    compared = settled(_chunk_bytes(rows.join(settled(by_doc), "doc_id")))
    kept = compared.filter("first").select("digest", F.col("bytes").alias("kept_bytes")).distinct()
    return (
        compared.filter("NOT first")
        .join(settled(kept), "digest")
        .filter(F.col("bytes") == F.col("kept_bytes"))
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without repeated chunks in their text; plus
    ``n_lines`` and ``n_removed``.

    Null and empty texts stay as they are (0 and 1 lines). Rows with a null id are not
    compared and stay. Of rows that repeat a doc_id, equal texts count as one document. A
    document whose chunks all occur earlier keeps an empty text. An empty table gives no rows.
    """
    gone = settled(
        repeated_chunks(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), "gone")
    ).withColumnRenamed("gone", "__gone")
    text = F.col(f"`{text_col}`")
    names = docs.columns
    joined = docs.join(gone, F.col(f"`{id_col}`") == F.col("__id"), "left")
    joined = joined.withColumn("__lines", F.split(text, "\n")).withColumn(
        "__out",
        F.expr("array_distinct(flatten(transform(__gone, r -> sequence(r.a, r.b - 1))))"),
    )
    joined = joined.withColumn(
        "__left",
        F.expr("array_except(sequence(0, greatest(size(__lines), 1) - 1), __out)"),
    )
    # Both arrays are arguments, so neither is computed anew for each line.
    joined = joined.withColumn(
        "__text", F.expr("array_join(transform(__left, i -> get(__lines, i)), '\n')")
    )
    return joined.select(
        *(
            F.when(F.col("__gone").isNull(), text).otherwise(F.col("__text")).alias(c)
            if c == text_col
            else F.col(f"`{c}`")
            for c in names
        ),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__lines") - F.size("__left")).cast("long").alias("n_removed"),
    )
