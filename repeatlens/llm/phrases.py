"""Phrase collocations: frequent word runs by mergeable Misra-Gries summaries, then exact counts.

1. Every task hashes the runs of one to four words of its texts and holds them in summaries,
   one for each hash partition. A task's summary is exact until it is full and then goes out.
2. Summaries of one hash partition are merged. A merged summary holds more counters than the
   partition's mass (its occurrences) divided by the least count asked for, so that all it
   ever subtracts from a counter stays below that count: every frequent run survives.
3. The survivors set bits in a filter of fixed size, which is broadcast. A second pass over the
   texts counts the runs that pass it exactly, by their words. A run that passes by chance
   is counted too and falls to the least count; a full filter costs time, never a result.

The tasks work on whole blocks of bytes with numpy and Arrow; words of a block have numbers
from Arrow's dictionary, and only distinct words and runs are ever touched one by one.

Lower case concerns A-Z only. Texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces
into words at spaces and tabs; a null text is empty, a null language ``und``. Ids are not
read: repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, settled
from repeatlens.operators.filters import matched

LONGEST = 4  # words of a phrase
BLOCK = 1 << 21  # bytes of text that are worked on at a time
HELD = 1 << 21  # counters that a task holds before its summaries go out
MASS = 1 << 23  # bytes of text for each hash partition
FILTER_BITS = 28  # the filter has 2^28 bits, 32 MB

_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)
_LEFT = 32  # bits of a hash that are kept beside the number of its partition


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = 1
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
    return kinds


_KINDS = _kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a block in order: number in ``known``, piece of the text, language."""

    known: pa.Array  # binary, each distinct word once
    number: np.ndarray
    piece: np.ndarray
    lang: np.ndarray


def words_of(text: pa.Array, lang: np.ndarray) -> Words:
    """The words of texts without nulls; ``lang`` has a number for each text."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    begins = (offsets[:-1] - offsets[0]).astype(np.int64)
    kind = _KINDS[raw]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    filled = begins[begins < len(raw)]
    first[filled] = inside[filled]  # a text ends a word even without a separator
    starts = np.flatnonzero(first)
    cuts = np.sort(np.concatenate([np.flatnonzero(kind == 2), begins]))
    piece = np.searchsorted(cuts, starts, "right").astype(np.int64)
    owner = np.searchsorted(begins, starts, "right") - 1
    # Of texts that begin at the same place all but the last are empty.
    kept = np.cumsum(inside, dtype=np.int32)
    ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int32)
    letters = _LOWER[raw[inside]]
    column = pa.Array.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]
    ).dictionary_encode()
    return Words(column.dictionary, column.indices.to_numpy(), piece, lang[owner])


def run_hashes(words: Words, lang_hash: np.ndarray) -> list[np.ndarray]:
    """For k = 1 to ``LONGEST``: 64-bit hashes of the runs of k words that begin at each word."""
    own = np.fromiter(
        (xxhash.xxh64_intdigest(w) for w in words.known.to_pylist()), np.uint64, len(words.known)
    )
    own = own[words.number] if len(own) else np.empty(0, np.uint64)
    h = _mixed(own ^ lang_hash[words.lang])
    out = [h]
    for k in range(1, LONGEST):
        h = _mixed(h[: max(len(own) - k, 0)] + own[k:])
        out.append(h)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _MIX
    return h ^ (h >> _U(32))


def _whole(words: Words) -> list[np.ndarray]:
    """For k = 1 to ``LONGEST``: which runs of k words lie in one piece."""
    n = len(words.piece)
    return [words.piece[: max(n - k, 0)] == words.piece[k:] for k in range(LONGEST)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[str]]]:
    """Texts in blocks of about ``BLOCK`` bytes, and their languages as numbers of a list."""
    for batch in batches:
        lang, text = batch.column(0).dictionary_encode(), batch.column(1)
        numbers, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        size = np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(text):
            done = size[at - 1] if at else 0
            to = max(int(np.searchsorted(size, done + BLOCK, "right")), at + 1)
            yield text.slice(at, to - at), numbers[at:to], names
            at = to


def _lang_hashes(names: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(n, seed=1) for n in names], np.uint64)


# --- summaries


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def merged(
    summary: tuple[np.ndarray, np.ndarray, int], keys: np.ndarray, counts: np.ndarray, capacity: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary (keys, counters, all that was subtracted) with more counts.

    While more than ``capacity`` counters are left, the next smaller counter is taken off
    all of them; each such step takes off more than ``capacity`` times as much mass.
    """
    keys, counts = summed(np.concatenate([summary[0], keys]), np.concatenate([summary[1], counts]))
    if len(keys) <= capacity:
        return keys, counts, summary[2]
    least = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > least
    return keys[left], counts[left] - least, summary[2] + least


def _packed(values: np.ndarray, kind: type) -> bytes:
    """Numbers as bytes, those of the same weight together, which compresses well."""
    return zlib.compress(values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


_SUMMARIES = pa.schema(
    [("p", pa.int64()), ("mass", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]
)


def _summaries(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for each hash partition at a time: its mass, and its counters."""
    bits = _U(64 - parts - _LEFT)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def out() -> pa.RecordBatch:
        keys, counts = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        p = (keys >> _U(_LEFT)).astype(np.int64)
        at = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p))
        rows = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            left = (keys[a:b] & _U((1 << _LEFT) - 1)).astype(np.uint32)
            rows.append((int(p[a]), int(counts[a:b].sum()), None, None))
            steps = np.diff(left, prepend=np.uint32(0))
            rows.append((int(p[a]), 0, _packed(steps, np.uint32), _packed(counts[a:b], np.int64)))
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _SUMMARIES, strict=True)], schema=_SUMMARIES
        )

    for text, lang, names in _blocks(batches):
        words = words_of(text, lang)
        runs = run_hashes(words, _lang_hashes(names))
        keys = np.concatenate([h[ok] for h, ok in zip(runs, _whole(words), strict=True)]) >> bits
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        if not len(first):
            continue
        held.append((keys[first], np.diff(np.append(first, len(keys)))))
        n_held += len(first)
        if n_held > HELD:
            yield out()
            held, n_held = [], 0
    if held:
        yield out()


_SURVIVORS = pa.schema([("p", pa.int64()), ("bits", pa.binary())])


def _survivors(
    parts: int, least: int, filter_bits: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Merges the summaries of each hash partition, which follow its masses."""
    empty = (np.empty(0, np.uint32), np.empty(0, np.int64), 0)
    down = _U(parts + _LEFT - filter_bits)
    at, mass, summary = None, 0, empty
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def settle() -> None:
        nonlocal summary, held, n_held
        if held:
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            summary = merged(summary, keys, counts, mass // least + 1)
        held, n_held = [], 0

    def out() -> pa.RecordBatch:
        settle()
        keys, counts, off = summary
        keys = keys[counts + off >= least].astype(np.uint64) + (_U(at) << _U(_LEFT))
        places = np.unique(keys >> down)
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int64()), pa.array([_packed(places, np.uint32)], pa.binary())],
            schema=_SURVIVORS,
        )

    for batch in batches:
        for row in batch.to_pylist():
            if row["p"] != at:
                if at is not None:
                    yield out()
                at, mass, summary = row["p"], 0, empty
            mass += row["mass"]
            if row["keys"] is not None:
                steps = _unpacked(row["keys"], np.uint32)
                held.append((np.cumsum(steps, dtype=np.uint32), _unpacked(row["counts"], np.int64)))
                n_held += len(steps)
                if n_held > max(mass // least, 1 << 18):
                    settle()
    if at is not None:
        yield out()


def frequent_filter(
    rows: DataFrame, least: int, filter_bits: int = FILTER_BITS
) -> np.ndarray:
    """A bit for each value of the first ``filter_bits`` bits of a run's hash: whether a run
    with this hash may occur ``least`` times. Rows are (lang, text) without nulls."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max((size // MASS).bit_length(), 1)  # 2^parts hash partitions
    summaries = map_arrow(
        rows, lambda b: _summaries(parts, b), "p long, mass long, keys binary, counts binary"
    )
    together = summaries.repartition("p").sortWithinPartitions("p", F.col("keys").isNotNull())
    found = map_arrow(
        together, lambda b: _survivors(parts, least, filter_bits, b), "p long, bits binary"
    )
    bits = np.zeros((1 << filter_bits) >> 3, np.uint8)
    for row in found.select("bits").toLocalIterator():
        places = _unpacked(row["bits"], np.uint32)
        np.bitwise_or.at(bits, places >> 3, np.uint8(1) << (places & 7).astype(np.uint8))
    return bits


# --- exact counts

_COUNTED = pa.schema(
    [("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("a", pa.int64())]
)


def _joined(parts: list[pa.Array]) -> pa.Array:
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))


def _counted(
    bits: np.ndarray, filter_bits: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of each block that pass the filter; 0 words: all of a language."""
    down = _U(64 - filter_bits)
    for text, lang, names in _blocks(batches):
        words = words_of(text, lang)
        number, where = words.number.astype(np.int64), words.lang.astype(np.int64)
        n = np.bincount(where, minlength=len(names))
        yield _rows(names, np.arange(len(names)), None, 0, n)
        before: np.ndarray | None = None
        ids: list[np.ndarray] = []  # of the runs of one word, of two
        for k, (h, whole) in enumerate(zip(run_hashes(words, _lang_hashes(names)), _whole(words), strict=True)):
            place = (h >> down).astype(np.int64)
            passed = whole & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
            if before is not None:  # a frequent run has frequent parts
                passed &= before[: len(passed)] & before[1 : len(passed) + 1]
            before = passed
            at = np.flatnonzero(passed)
            if not len(at):
                break
            if k == 0:
                key = where[at] << 32 | number[at]
            elif k == 1:
                key = ids[0][at] << 32 | number[at + 1]
            elif k == 2:
                key = ids[1][at] << 32 | number[at + 2]
            else:
                key = ids[1][at] << 32 | ids[1][at + 2]
            _, first, same, counts = np.unique(
                key, return_index=True, return_inverse=True, return_counts=True
            )
            if k < 2:
                dense = np.full(len(passed), -1, np.int64)
                dense[at] = same
                ids.append(dense)
            first = at[first]
            parts = [words.known.take(pa.array(words.number[first + i])) for i in range(k + 1)]
            yield _rows(names, where[first], _joined(parts), k + 1, counts)


def _rows(names: list[str], lang: np.ndarray, phrase: pa.Array | None, k: int, n: np.ndarray):
    phrase = pa.nulls(len(n), pa.binary()) if phrase is None else phrase
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()).take(pa.array(lang)),
            phrase,
            pa.array(np.full(len(n), k, np.int32)),
            pa.array(n.astype(np.int64)),
        ],
        schema=_COUNTED,
    )


def run_counts(
    docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """lang, phrase, words and a of every run of one to four words that occurs at least
    ``least`` times in its language, counted exactly; and for each language a row with 0
    words, a null phrase and the number of all its words."""
    rows = docs.select(
        F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    bits = rows.sparkSession.sparkContext.broadcast(frequent_filter(rows, least))
    counted = map_arrow(
        rows,
        lambda b: _counted(bits.value, FILTER_BITS, b),
        "lang string, phrase binary, words int, a long",
    )
    return (
        counted.groupBy("lang", "words", F.col("phrase").cast("string").alias("phrase"))
        .agg(F.sum("a").alias("a"))
        .filter((F.col("a") >= least) | (F.col("words") == 0))
    )


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def _part(words: str, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every run of two words or more: the cut with
    the lowest floor(2,000,000 a / (l + r)), the first such cut on a tie."""
    known = counts.select("lang", "phrase", "a")
    cuts = counts.filter("words >= 2").withColumn("w", F.split("phrase", " ", -1))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("cut")
    )
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "cut",
        _part("w", F.lit(1), F.col("cut")).alias("left"),
        _part("w", F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        other = known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name))
        cuts = matched(cuts, other, ["lang", side], "inner")
    top = _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumn("n2", top).withColumn("d2", _exact(F.col("l")) + _exact(F.col("r")))
    best = F.min(F.struct(F.expr("n2 div d2").alias("score"), "cut", "l", "r")).alias("best")
    return (
        cuts.groupBy("lang", "phrase", "words", "a").agg(best)
        .select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")
    )


def covered(counts: DataFrame, share: int = 80) -> DataFrame:
    """lang, phrase and the largest count of a longer run that holds the phrase."""
    longer = counts.filter("words >= 3").withColumn("w", F.split("phrase", " ", -1))
    spans = F.expr(
        "flatten(transform(sequence(2, words - 1), n ->"
        " transform(sequence(1, words - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    )
    inner = longer.select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))


def collocations(
    docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of two to four words that occur at least ``least`` times; a phrase of which
    ``share`` per cent or more of the occurrences of the phrase are those of a longer one
    around it goes. By score, then count, both descending, then phrase in byte order.
    An empty table, and texts without words, give no rows.
    """
    counts = settled(run_counts(docs, least, text_col, lang_col))
    around = covered(counts)
    rows = scored(counts)
    rows = matched(rows, around, ["lang", "phrase"], "left")
    hidden = _exact(F.col("around")) * 100 >= _exact(F.col("a")) * share
    rows = rows.filter(F.col("around").isNull() | ~hidden)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # First in slices of a language, then in the whole of it: no task sorts more than its
    # slice, or what the slices have left.
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(sliced)).filter(F.col("rank") <= top)
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", ranked).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("a").alias("n"))
    return rows.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
