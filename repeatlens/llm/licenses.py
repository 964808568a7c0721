"""License scan: an exact set-similarity join of text blocks with license templates.

A template is a set of words, and a block matches if it holds a share of them (containment).
Words are ordered by the number of documents that hold them, rarest first, over the whole
table. Of a template with t words, o of which must be found, one of its t - o + 1 rarest
words is in every matching block (prefix filter), at places from which o common words can
still follow (positional filter), in blocks with at least o words of the templates (length
filter). What is left is compared word by word, so no matching block is missed.

A template of up to S words, S a power of two, meets blocks of 2 S words that begin at every
S-th word: any run of S + 1 words lies inside one block, wherever it begins.

Templates marked as phrases need all their words one after the other; the join finds the
blocks, and the places inside the first half of a block count, so each counts once.

Words are runs of digits, letters a-z (A-Z in lower case) and everything beyond ASCII. The
number of templates and their words is the caller's; they are broadcast. A null text has no
words; repeated rows are scanned each for itself, null ids stay null, other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import map_arrow, texts


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    share: float = 0.8
    phrase: bool = False  # words one after the other


# The phrases of the base scan and their labels.
PHRASES = (
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
)

# Notices by which the licenses ask to be named, and their labels. Short ones
# have to be complete, or a word of another license could take the place of the name.
NOTICES = (
    Template("apache", "licensed under the apache license version 2 0", 1.0),
    Template("apache", "you may not use this file except in compliance with the license you may"
             " obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification"
             " are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    Template("gpl", "licensed under the gnu general public license version 3", 1.0),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the"
             " terms of the gnu general public license as published by the free software foundation"),
    Template("mit", "released under the mit license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
             " software and associated documentation files to deal in the software without restriction"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied"
             " including but not limited to the warranties of merchantability fitness for a particular"
             " purpose and noninfringement"),
)
TEMPLATES = PHRASES + NOTICES

LEAST_BLOCK = 4

_WORDS = bytes(b for b in range(256) if re.match(rb"[0-9a-z\x80-\xff]", bytes([b]).lower()))
_SPACED = bytes(bytes([b]).lower()[0] if b in _WORDS else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACED).split()


def step_of(template: Template) -> int:
    """S: every how many words a block of this template begins."""
    return max(LEAST_BLOCK, 1 << (len(words_of(template.text)) - 1).bit_length())


def needed(template: Template) -> int:
    n = len(set(words_of(template.text)))
    return ceil(n * template.share - 1e-9)


def document_counts(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many rows of ``docs`` (doc_id, text) each of the words occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(words.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"],
        )

    counted = map_arrow(docs.select("text"), run, "word binary, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).collect()  # words of the templates only
    return {bytes(r["word"]): r["n"] for r in rows}


def frequency_order(docs: DataFrame, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """The words of the templates with their ranks, from the rarest in ``docs`` on."""
    words = {w for t in templates for w in words_of(t.text)}
    counts = document_counts(docs, words)
    return {w: i for i, w in enumerate(sorted(words, key=lambda w: (counts.get(w, 0), w)))}


def template_rows(templates: tuple[Template, ...], ranks: dict[bytes, int]) -> list[tuple]:
    """For each word of a template's prefix: step, word, template, label, phrase, place in the
    template, its words in order of rank, its prefix, how many are needed, and its run."""
    rows = []
    for k, t in enumerate(templates):
        run = [ranks[w] for w in words_of(t.text)]
        held = sorted(set(run))
        need = needed(t)
        prefix = held[: len(held) - need + 1]
        rows += [
            (step_of(t), word, k, t.label, t.phrase, place, held, prefix, need, run)
            for place, word in enumerate(prefix)
        ]
    return rows


_TEMPLATE_ROWS = (
    "step int, word int, template int, label string, phrase boolean, place int,"
    " held array<int>, prefix array<int>, need int, run array<int>"
)
_SCANNED = "doc_id long, n_words long, blocks array<struct<step: int, start: long, seq: array<int>>>"
_BLOCK = pa.struct([("step", pa.int32()), ("start", pa.int64()), ("seq", pa.list_(pa.int32()))])


def _scan(
    ranks: dict[bytes, int], prefixes: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """The number of words of each text, and its blocks that hold a word of a prefix."""
    rank = ranks.get
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, found = [], []
            for text in part.column(1):
                words = words_of(text.as_py())
                seq = np.fromiter(map(rank, words, repeat(-1)), np.int32, len(words))
                sizes.append(len(words))
                known = np.flatnonzero(seq >= 0)
                blocks = []
                for step, wanted in prefixes.items() if len(known) else ():
                    at_block = np.unique(known[wanted[seq[known]]] // step)
                    starts = np.union1d(at_block, at_block[at_block > 0] - 1) * step
                    blocks += [
                        {"step": step, "start": s, "seq": seq[s : s + 2 * step]} for s in starts.tolist()
                    ]
                found.append(blocks)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_BLOCK))],
                names=["doc_id", "n_words", "blocks"],
            )


def license_blocks(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every block of every text with each template that it matches.

    row (a number for each row of ``docs``), doc_id, n_words, template (its number), label,
    phrase, start (the block's first word), containment, and for phrases places (the words at
    which they start). A text without a match has one row with a null template. One job runs
    while this is built: it counts the documents of each word.
    """
    spark = docs.sparkSession
    plain = texts(docs, id_col, text_col)
    ranks = frequency_order(plain, templates)
    rows = template_rows(templates, ranks)
    prefixes: dict[int, np.ndarray] = {}
    for step, word, *_ in rows:
        prefixes.setdefault(step, np.zeros(len(ranks), bool))[word] = True
    shared = spark.sparkContext.broadcast((ranks, prefixes))
    scanned = map_arrow(plain, lambda b: _scan(*shared.value, b), _SCANNED)

    wanted = F.broadcast(spark.createDataFrame(rows, _TEMPLATE_ROWS))
    blocks = scanned.withColumn("row", F.monotonically_increasing_id())
    blocks = blocks.select("row", "doc_id", "n_words", F.explode_outer("blocks").alias("b"))
    held = F.array_sort(F.array_distinct(F.filter("b.seq", lambda r: r >= 0)))
    blocks = blocks.select("row", "doc_id", "n_words", "b.*", held.alias("own"))
    meets = blocks.select("*", F.posexplode_outer("own").alias("at", "word"))
    pairs = meets.join(wanted, ["step", "word"], "left")
    # A pair meets at its first common word of the prefix; o words can still follow there.
    first = F.col("word") == F.array_min(F.array_intersect("own", "prefix"))
    follow = F.least(F.size("held") - F.col("place"), F.size("own") - F.col("at"))
    common = F.size(F.array_intersect("own", "held"))
    spots = F.filter(
        F.sequence(F.lit(0), F.col("step") - 1),
        lambda p: F.slice("seq", p + 1, F.size("run")) == F.col("run"),
    )
    pairs = pairs.withColumn("proposed", F.coalesce(first & (follow >= F.col("need")), F.lit(False)))
    pairs = pairs.withColumn("common", F.when(F.col("proposed"), common))
    pairs = pairs.withColumn("places", F.when(F.col("phrase") & F.col("proposed"), spots))
    hit = F.col("common") >= F.col("need")
    hit = F.coalesce(hit & (~F.col("phrase") | (F.size("places") > 0)), F.lit(False))
    kept = [F.when(hit, F.col(c)).alias(c) for c in ("template", "label", "phrase", "start")]
    return pairs.select(
        "row", "doc_id", "n_words", *kept,
        F.when(hit, F.col("common") / F.size("held")).alias("containment"),
        F.when(hit, F.transform("places", lambda p: p + F.col("start"))).alias("places"),
    )


def license_digests(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row for each text: doc_id, n_words, n_base (places of phrases), first_word and
    last_word (of them), base_labels, labels (all, sorted), score (largest containment of a
    matching template, else 0)."""
    found = license_blocks(docs, templates, id_col, text_col)
    phrase = F.coalesce("phrase", F.lit(False))

    def listed(labels):
        return F.array_join(F.array_sort(F.collect_set(labels)), ",")

    return (
        found.groupBy("row", "doc_id", "n_words")
        .agg(
            F.sum(F.coalesce(F.size("places"), F.lit(0)).cast("long")).alias("n_base"),
            F.min(F.array_min("places")).alias("first_word"),
            F.max(F.array_max("places")).alias("last_word"),
            listed(F.when(phrase, F.col("label"))).alias("base_labels"),
            listed(F.col("label")).alias("labels"),
            F.coalesce(F.max("containment"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
