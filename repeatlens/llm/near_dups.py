"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A text becomes the set of its word shingles, hashed to 64 bits. Sketching fills ``SIZE``
coordinates by rounds (Dahlgaard, Knudsen, Thorup 2017): in each of the first SIZE rounds
every shingle is hashed to one bin with a value, and earlier rounds beat later ones; in
round SIZE + i every shingle goes to bin i. So every coordinate is filled, even from one
shingle, and matches concentrate as with independent coordinates. Rounds stop once all
bins are filled.

Texts with equal sets form a class, found by grouping on a digest of the set; from there
only classes are compared. Bands of four coordinates put classes into buckets. Within a
bucket only some pairs are needed, since links are for components: first every member is
verified against one member of each of its buckets, a different one in every bucket (stars);
then, in buckets that still hold several components, the members outside the bucket's
largest component are verified against members of other components with which they share
one of their rarest shingles, as linked sets must. So a link between two members of a
bucket is found or implied. At a similarity of 0.8 two classes share none
of the 32 buckets with a chance of (1 - 0.8^4)^32 = 5e-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, settled, texts
from repeatlens.llm.components import connected_components

SIZE = 128
WIDTH = 4
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
_VALUE_BITS = 50
ROWS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (Stafford's variant 13)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SEEDS = _mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of lower-cased words; all the words as
    one shingle if they are fewer; empty without words."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(shingle, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def sketch(values: np.ndarray) -> np.ndarray:
    """The SIZE coordinates of a non-empty set."""
    out = np.zeros(SIZE, np.uint64)
    empty = np.ones(SIZE, bool)
    at, keep = 0, _U((1 << _VALUE_BITS) - 1)
    # So many rounds at once that they probably fill all bins; later rounds lose anyway.
    step = int(np.clip(6 * SIZE / len(values), 1, SIZE))
    while at < SIZE:
        seeds = _SEEDS[at : at + step, None]
        h = _mix(values[None, :] ^ seeds)
        rank = np.arange(len(seeds), dtype=np.uint64)[:, None] << _U(_VALUE_BITS)
        key = (h >> _U(57) << _U(57)) | rank | (h & keep)
        key = np.sort(key, axis=None)
        bins = (key >> _U(57)).astype(np.int64)
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        new = first[empty[bins[first]]]
        out[bins[new]] = key[new] & keep
        empty[bins[new]] = False
        if not empty.any():
            return out
        at += step
    rest = np.flatnonzero(empty)
    forced = _mix(values[None, :] ^ _SEEDS[SIZE + rest, None]) & keep
    out[rest] = forced.min(axis=1)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One key for each band; keys of different bands differ."""
    rows = coordinates.reshape(-1, WIDTH)
    h = _mix(np.arange(1, len(rows) + 1, dtype=np.uint64))
    for k in range(WIDTH):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def _digest(values: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty) and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, digests, bands = [], [], []
                for text in part.column(1).to_pylist():
                    values = shingle_set(text, shingle)
                    n.append(len(values))
                    digests.append(_digest(values))
                    bands.append(band_keys(sketch(values)).view(np.int64) if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"],
                )

    return map_arrow(docs, run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, set (array of long) and parity of the rows whose set has the digest they name.

    The parity has a bit for each of 512 parts of the items: whether an odd number is there.
    Bits in which two parities differ cannot outnumber the items in which the sets differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, sets, parities = [], [], []
                for i, text, digest in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    values = shingle_set(text, shingle)
                    if _digest(values) == digest:
                        ids.append(i)
                        sets.append(values.view(np.int64))
                        parts = np.bincount((values >> _U(40)).astype(np.int64) % 512, minlength=512)
                        parities.append(np.packbits((parts & 1).astype(np.uint8)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64()))],
                    names=["id", "items", "parity"],
                )

    schema = "id long, items array<long>, parity array<long>"
    return map_arrow(docs.select("doc_id", "text", "digest"), run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    of_a = sets.select(F.col("id").alias("a"), F.col("items").alias("items_a"))
    of_b = sets.select(F.col("id").alias("b"), F.col("items").alias("items_b"))
    both = pairs.join(of_a, "a").join(of_b, "b")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b")


def _prefixes(open_classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The open classes with the items by which a link between them must show.

    A link needs an intersection of percent / (100 + percent) of both sizes, and no partner
    is smaller than ``smallest`` or than percent of the set. So two linked sets share an item
    among the rarest n - needed + 1 of each, rarest counted over the open classes (prefix
    filter). Items that one class alone has take their places in it but join nothing: heavily
    edited copies of one text, of which a bucket may hold many, are not paired at all.
    """
    ids = open_classes.select(F.col("class").alias("id"))
    parities = sets.select(F.col("id").alias("class"), "parity")
    items = settled(sets.join(ids, "id").select("id", F.explode_outer("items").alias("item")))
    rarity = settled(items.groupBy("item").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    listed = items.join(rarity, "item").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("m", "item"))).alias("common")
    )
    joined = open_classes.join(listed.withColumnRenamed("id", "class"), "class").join(parities, "class")
    least = F.greatest(F.col("smallest"), F.ceil(F.col("n") * percent / 100))
    needed = F.ceil((F.col("n") + least) * percent / (100 + percent))
    take = F.size("common") - needed + 1  # own items come first and are left out
    cut = joined.withColumn("take", take).filter("take > 0")
    columns = ["class", "n", "component", "outside", "parity"]
    return cut.select(
        *columns, F.explode_outer(F.expr("slice(common, 1, take)")).alias("i")
    ).select(*columns, "i.item")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|, on whole sets. Texts
    without words, and null texts, have an empty set and no links. Of rows that repeat a
    doc_id, the text with the smallest digest stands for the document in the links, and each
    row is returned. Rows with a null id are left alone: component null, kept. An empty table
    gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    sketched = settled(_sketched(rows, shingle))
    own = (
        sketched.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("digest").alias("digest"))
        .filter(F.col("digest").isNotNull())
    )
    # A class for each distinct set, named by its smallest doc_id.
    classes = settled(own.groupBy("digest").agg(F.min("doc_id").alias("class")))
    banded = settled(
        classes.join(
            sketched.select(F.col("doc_id").alias("class"), "digest", "n_shingles", "bands"),
            ["class", "digest"],
        )
        .dropDuplicates(["class", "digest"])  # a class has one digest: as the join has dealt them
        .select("class", "digest", F.col("n_shingles").alias("n"), "bands")
    )
    # Every class has 32 of these rows: its digest joins those that are left.
    members = banded.select("class", "n", F.explode("bands").alias("bucket"))
    # The hub of a bucket is the member least by its id XOR the bucket's key: members meet
    # other hubs in other buckets.
    crowds = settled(
        members.groupBy("bucket")
        .agg(F.min(F.expr("class ^ bucket")).alias("least"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select("bucket", F.expr("least ^ bucket").alias("hub"))
    )
    shared = settled(members.join(crowds, "bucket"))
    wanted = banded.select("class", "digest").join(shared.select("class"), "class", "left_semi")
    wanted = wanted.withColumnRenamed("class", "doc_id")
    sets = settled(_sets(rows.join(wanted, "doc_id"), shingle).dropDuplicates(["id"]))

    stars = settled(
        shared.filter("class != hub")
        .select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b"))
        .distinct()
    )
    found = settled(connected_components(_verified(stars, sets, percent)))

    # Buckets that still hold several components.
    apart = shared.join(found.withColumnRenamed("id", "class"), "class", "left").select(
        "bucket", "class", "n", F.coalesce("component", "class").alias("component")
    )
    apart = settled(apart)
    parts = apart.groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("m"), F.min("n").alias("smallest")
    )
    mixed = settled(
        parts.groupBy("bucket")
        .agg(
            F.max_by("component", F.col("m")).alias("main"),
            F.min("smallest").alias("smallest"),
            F.count(F.lit(1)).alias("parts"),
        )
        .filter("parts > 1")
        .drop("parts")
    )
    open_rows = apart.join(mixed, "bucket")
    x = open_rows.withColumn("outside", F.col("component") != F.col("main")).groupBy("class").agg(
        F.first("n").alias("n"),
        F.first("component").alias("component"),
        F.max("outside").alias("outside"),
        F.min("smallest").alias("smallest"),
    )
    prefixes = settled(_prefixes(settled(x), sets, percent))
    side = F.struct("class", "n", "component", "parity")
    sizes = F.col("x.n") + F.col("y.n")
    differ = F.expr(" + ".join(f"bit_count(get(x.parity, {i}) ^ get(y.parity, {i}))" for i in range(8)))
    across = (
        prefixes.filter("outside")
        .select("item", side.alias("x"))
        .join(prefixes.select("item", side.alias("y")), "item")
        .filter("x.component != y.component")
        .filter(100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
        # Linked sets differ in at most so many items.
        .filter((100 + percent) * (sizes - differ) >= 2 * percent * sizes)
        .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    more = _verified(across, sets, percent)
    final = connected_components(
        found.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more)
    )
    placed = own.join(classes, "digest").join(
        final.withColumnRenamed("id", "class"), "class", "left"
    )
    placed = placed.select("doc_id", F.coalesce("component", "class").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return sketched.join(placed, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
