"""Prefix trie of conversations: ROLLUP over positional columns of turn ids.

A turn id is 128 bits of the SHA-256 of role and text. The ids of a conversation stand in
blocks of ``BLOCK`` columns, one row for each block; position 0 holds the textless root.
``GROUP BY block, key, ROLLUP (t0, t1, ...)`` makes every prefix of every block at once, and
``grouping_id`` says how long it is. ``key`` identifies the node at which the prior block
ended: a sum of 96-bit hashes of the blocks before, each hashed with its place, so blocks of
long conversations need no rounds: all of them go through one ROLLUP.

Sums over subtrees need no walk over the tree either. The smallest member of a node is also
the smallest member of its descendants on its own path, so each distinct node belongs to
exactly one conversation, and those a conversation owns are the end of its path. A sum over
the distinct nodes of a subtree is then a sum over the members' owned parts, which a second
ROLLUP adds up.

No group is gathered: positions come from range partitions (any number of turns in one
conversation), members are summed before the shuffle, and the list of the members that end
at a node is packed into long texts where it is sorted, before one task hashes it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, settled
from repeatlens.operators.filters import matched
from repeatlens.operators.ranking import number_rows, running_sums

BLOCK = 4  # positions of a block, its columns in the ROLLUP
SHARED = 5  # conversations that take their first turns from the same one
HEADS = 9  # their number is below this
PACK = 1 << 20  # characters of a packed list of members

_ID = "decimal(38,0)"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tid, bytes and n: each distinct turn of a conversation and how often
    it stands there. Null role and text are empty; rows without a conv_id are left out."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    tid = F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 32))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        tid.alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    keys = ["conv_id", "turn", "tid", "bytes"]
    return rows.filter("conv_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))


def heads_taken(conv_id: Column) -> Column:
    """How many first turns a conversation takes from another one: crc32 of its id."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, part, turn, tid, bytes, n) in which conversation c begins with the
    first h turns of conversation c - c % 5, followed by its own after its first h.

    Part 0 is the beginning, part 1 the rest. Equal turn numbers follow each other by turn id.
    """
    ids = turns.select("conv_id").distinct()
    most = HEADS - 1
    order = [F.col("turn").asc_nulls_first(), F.col("tid"), F.col("copy")]
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(most))))
    first = turns.withColumn("copy", copy).withColumn("pos", place).filter(F.col("pos") <= most)
    taken = heads_taken(F.col("conv_id"))

    keys = ["conv_id", "turn", "tid", "bytes"]
    replaced = first.filter(F.col("pos") <= taken).groupBy(*keys).agg(F.count("*").alias("gone"))
    rest = matched(turns, replaced, keys, "left").withColumn(
        "n", F.col("n") - F.coalesce(F.col("gone"), F.lit(0))
    )
    rest = rest.filter("n > 0").select("conv_id", F.lit(1).alias("part"), "turn", "tid", "bytes", "n")

    near = F.sequence(F.lit(1 - SHARED), F.lit(SHARED - 1))
    begun = first.filter(F.col("conv_id") % SHARED == 0).withColumn("step", F.explode(near))
    begun = begun.withColumnRenamed("conv_id", "base").withColumn(
        "conv_id", F.try_add("base", F.col("step").cast("long"))
    )
    own_base = F.col("conv_id") - F.col("conv_id") % SHARED == F.col("base")
    begun = begun.filter(own_base & (F.col("pos") <= taken))
    begun = matched(begun.drop("n"), ids, ["conv_id"], "left_semi")
    begun = begun.groupBy(*keys).agg(F.count("*").alias("n"))
    return begun.select("conv_id", F.lit(0).alias("part"), "turn", "tid", "bytes", "n").union(rest)


def _hash96(data: Column) -> Column:
    hexed = F.sha2(data, 256)
    high, low = (F.conv(F.substring(hexed, at, 12), 16, 10).cast("decimal(15,0)") for at in (1, 13))
    return (high * F.lit(1 << 48).cast("decimal(15,0)") + low).cast("decimal(29,0)")


def _place_hash(block: Column, ids: Column) -> Column:
    """96 bits of a block's place and its turn ids."""
    joined = F.array_join(F.transform(ids, F.hex), "")
    return _hash96(F.concat(block.cast("string"), F.lit(":"), joined).cast("binary"))


def blocks_of(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each block of each conversation: conv_id, j, tids, sizes (bytes of its
    turns), key (96-bit sums over the blocks before), till (with this block), before and
    upto (bytes in front of it and up to its end)."""
    order = ["part", "turn", "tid", "bytes"]
    placed = number_rows(turns, ["conv_id"], order, copies="n")
    root = ids.select(
        "conv_id", F.lit(0).cast("long").alias("_position"), F.lit(b"").alias("tid"),
        F.lit(0).cast("long").alias("bytes"),
    )
    spots = placed.select("conv_id", "_position", "tid", "bytes").union(root)
    j = F.floor(F.col("_position") / block).cast("long")
    gathered = F.sort_array(F.collect_list(F.struct("_position", "tid", "bytes")))
    rows = spots.groupBy("conv_id", j.alias("j")).agg(gathered.alias("spots"))
    rows = rows.select(
        "conv_id", "j", F.col("spots.tid").alias("tids"), F.col("spots.bytes").alias("sizes")
    )
    own = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    rows = rows.withColumns({"own_hash": _place_hash(F.col("j"), F.col("tids")), "own_bytes": own})
    sums = {"till": F.col("own_hash").cast(_ID), "upto": F.col("own_bytes")}
    rows = running_sums(rows, ["conv_id"], ["j"], sums)
    return rows.select(
        "conv_id", "j", "tids", "sizes",
        (F.col("till") - F.col("own_hash")).cast(_ID).alias("key"), F.col("till").cast(_ID).alias("till"),
        (F.col("upto") - F.col("own_bytes")).alias("before"), "upto",
    )


def _rolled(blocks: DataFrame, measures: str, block: int) -> DataFrame:
    """``measures`` of every prefix of every block, with nid (its id), pid (its parent's,
    null for the root), j, level (columns that are set) and depth."""
    columns = [f"t{i}" for i in range(block)]
    spread = blocks.withColumns({c: F.get("tids", F.lit(i)) for i, c in enumerate(columns)})
    names = ", ".join(columns)
    rows = spread.sparkSession.sql(
        f"SELECT j, key, {names}, grouping_id() AS gid, {measures} FROM {{rows}}"
        f" GROUP BY j, key, ROLLUP ({names})",
        rows=spread,
    )
    rows = rows.withColumn("level", F.lit(block) - F.bit_count("gid"))
    ids = F.array(*columns)
    # A prefix whose last column is null belongs to a conversation that has ended before.
    rows = rows.filter((F.col("level") > 0) & F.element_at(ids, F.greatest("level", F.lit(1))).isNotNull())

    def node(level: Column) -> Column:
        return (F.col("key") + _place_hash(F.col("j"), F.slice(ids, F.lit(1), level))).cast(_ID)

    parent = F.when(F.col("level") > 1, node(F.col("level") - 1)).when(F.col("j") > 0, F.col("key"))
    return rows.withColumns(
        {"nid": node(F.col("level")), "pid": parent, "depth": F.col("j") * block + F.col("level") - 1}
    ).drop(*columns, "key", "gid")


def prefix_trie(ids: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every distinct prefix of the conversations as a node.

    ``ids`` has every conv_id once, ``turns`` is as ``rebuilt`` returns it. Returns conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (of
    its subtree: bytes of last texts that more than one member shares, once for each further
    member) and ends_sha256 (of the members that end there). No conversations, no nodes.
    """
    blocks = settled(blocks_of(ids, turns, block))
    ends = blocks.groupBy("conv_id").agg(
        F.max("upto").alias("total"), F.max(F.struct("j", "till")).alias("last")
    )
    ends = settled(ends.select("conv_id", "total", F.col("last.till").alias("nid")))
    whole = matched(blocks, ends.select("conv_id", "total"), ["conv_id"], "inner")
    nodes = _rolled(whole, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(total) AS totals", block)

    # Bytes in front of the node, as its smallest member has them.
    mine = whole.select("conv_id", "j", "sizes", "before", "total")
    nodes = matched(nodes, mine, ["conv_id", "j"], "inner")
    until = F.slice("sizes", F.lit(1), F.col("level") - 1)
    inside = F.aggregate(until, F.lit(0).cast("long"), lambda a, b: a + b)
    nodes = settled(
        nodes.select("nid", "pid", "depth", "conv_id", "n_convs", "totals", "total",
                     (F.col("before") + inside).alias("front"))
    )
    children = nodes.filter("pid IS NOT NULL").groupBy(F.col("pid").alias("nid"))
    children = children.agg(F.count("*").alias("n_children"))
    nodes = settled(matched(nodes, children, ["nid"], "left").fillna(0, ["n_children"]))

    owned = F.max(F.col("total") - F.col("front"))  # the topmost node it owns has least in front
    owners = nodes.groupBy("conv_id").agg(
        owned.alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    owners = settled(owners)
    held = matched(blocks, owners, ["conv_id"], "inner")
    below = _rolled(held, "sum(own) AS owned, sum(leaf) AS n_leaves", block)
    out = matched(nodes, below.select("nid", "owned", "n_leaves"), ["nid"], "inner")
    out = matched(out, owners.select("conv_id", "own"), ["conv_id"], "inner")
    above = nodes.select(F.col("nid").alias("pid"), F.col("conv_id").alias("parent_conv_id"))
    out = matched(out, above, ["pid"], "left")
    out = matched(out, member_digests(ends), ["nid"], "left")
    saved = (
        F.col("totals") - (F.col("n_convs") - 1) * F.col("front")
        - (F.col("owned") - F.col("own")) - F.col("total")
    )
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", nobody).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt`` and ``prefix_trie``).

    Conversations are ordered by turn, null first; repeated rows stay repeated turns. Other
    columns are ignored.
    """
    turns = settled(turns_of(conversations))
    return prefix_trie(turns.select("conv_id").distinct(), rebuilt(turns), block)


# --- lists of members

_PACKED = "nid decimal(38,0), first long, members string"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the same node joined to texts; rows come in the order of node and conv_id."""
    node, first, members, size = None, 0, [], 0
    rows: list[tuple] = []
    for batch in batches:
        for nid, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if nid != node or size > PACK:
                if members:
                    rows.append((node, first, ",".join(members)))
                node, first, members, size = nid, conv, [], 0
            members.append(str(conv))
            size += len(members[-1]) + 1
        yield _batch(rows)
        rows = []
    if members:
        yield _batch([(node, first, ",".join(members))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    nid, first, members = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(nid, pa.decimal128(38, 0)), pa.array(first, pa.int64()), pa.array(members, pa.string())],
        names=["nid", "first", "members"],
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, joined by commas; they come in order."""
    node, state = None, hashlib.sha256()
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        nid, digests = zip(*done, strict=True) if done else ((), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(nid, pa.decimal128(38, 0)), pa.array(digests, pa.string())],
            names=["nid", "ends_sha256"],
        )

    for batch in batches:
        for nid, members in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if nid == node:
                state.update(b",")
            else:
                if node is not None:
                    done.append((node, state.hexdigest()))
                node, state = nid, hashlib.sha256()
            state.update(members.encode())
        yield out()
        done = []
    if node is not None:
        done.append((node, state.hexdigest()))
        yield out()


def member_digests(ends: DataFrame) -> DataFrame:
    """nid and ends_sha256, the SHA-256 of the comma-joined ascending conv_ids, for rows
    (nid, conv_id). A hot node's ids are sorted and packed by many tasks."""
    ranges = ends.select("nid", "conv_id").repartitionByRange("nid", "conv_id")
    packed = map_arrow(ranges.sortWithinPartitions("nid", "conv_id"), _pack, _PACKED)
    together = packed.repartition("nid").sortWithinPartitions("nid", "first")
    return map_arrow(together, _digest, "nid decimal(38,0), ends_sha256 string")
