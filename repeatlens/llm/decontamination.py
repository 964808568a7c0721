"""Benchmark decontamination by spaced-seed hashing, by built-in functions only.

A mask names which tokens of a window count; the others are ignored, so a substituted
token under a gap does not hide a passage. Hashes of all masked windows of the documents
are joined with those of the benchmark. Every hit fixes how document and item lie against
each other; around it, tokens are compared one by one, and the pair counts if a stretch of
``WINDOW`` tokens that holds the hit agrees in ``share`` of them.

The masks miss no such pair for a share of 0.8 or more: in 15 tokens with any 3 substituted
at least one of ``MASKS`` fits between the substitutions, and so in every longer stretch and
in 14 tokens with 2. Overlaps of 8 to 13 tokens, of short items or at the ends of a document,
have ``SHORT_MASKS`` besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repeatlens.llm.common import settled, texts

MASKS = ("101001111", "1111000101", "1101100011")
SHORT_MASKS = ("11101001", "110111")
LEAST = 14  # tokens from which MASKS are enough
WINDOW = 16
# Benchmark hashes up to this number (16 bytes each) are broadcast; beyond, both sides are
# shuffled by hash.
BROADCAST_ROWS = 500_000


def _tokens(text: str) -> str:
    """Hashes of the lower-cased runs of letters and digits."""
    return (
        f"transform(array_remove(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), ''),"
        " t -> xxhash64(t))"
    )


def _masked(tokens: str, places: str, mask: str, number: int) -> str:
    """The hash at each of the places, in order; null where the window passes the end."""
    taken = ", ".join(f"get({tokens}, i + {k})" for k, c in enumerate(mask) if c == "1")
    last = f"size({tokens}) - {len(mask)}"
    return f"transform({places}, i -> if(i <= {last}, xxhash64({number}, {taken}), NULL))"


def _all_masked(tokens: str) -> str:
    long = [_masked(tokens, "places", m, k) for k, m in enumerate(MASKS)]
    short = [_masked(tokens, "ends", m, k) for k, m in enumerate(SHORT_MASKS, len(MASKS))]
    return "concat(" + ", ".join(long + short) + ")"


def _seeds(rows: DataFrame, key: str, ends_only: bool) -> DataFrame:
    """(key, p, h): masked hashes with their token positions.

    With ``ends_only`` the short masks are laid only where an overlap of less than ``LEAST``
    tokens with a longer item can lie: over the first and last tokens.
    """
    side = LEAST - 1
    placed = rows.withColumn("n", F.size("tokens")).withColumn(
        "m", F.least("n", F.lit(2 * side)) if ends_only else F.col("n")
    )
    placed = placed.withColumn("places", F.expr("slice(sequence(0, n), 1, n)")).withColumn(
        "ends", F.expr(f"transform(slice(sequence(0, m), 1, m), x -> if(x < {side}, x, x + n - m))")
    )
    hashed = placed.withColumn("all", F.expr(_all_masked("tokens")))
    # The outer form: for the plain one a filter on the array's size would be inferred and
    # moved below the tokens, which would then be computed anew for each position.
    long = f"{len(MASKS)} * n"
    return (
        hashed.select(key, "n", "m", F.posexplode_outer("all").alias("p", "h"))
        .filter(F.col("h").isNotNull())
        .withColumn("e", F.expr(f"if(p < {long}, NULL, (p - {long}) % m)"))
        .select(key, F.expr(f"CASE WHEN e IS NULL THEN p % n WHEN e < {side} THEN e ELSE e + n - m END").alias("p"), "h")
    )


def _contexts(marks: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, h, p, before, after, near): each mark with the tokens around it, as many as the
    windows that hold the mark can reach: ``before`` tokens ahead of p, ``after`` from p on.

    Marks of one text in equal surroundings compare alike with any other text, so only the
    first of them is kept. A word or phrase repeated all through a text leaves a few marks.
    """
    side = WINDOW - 1
    both = marks.join(rows, key).withColumn("n", F.size("tokens")).filter("p < n")
    return (
        both.withColumn("before", F.least("p", F.lit(side)).cast("int"))
        .withColumn("after", F.expr(f"greatest(0, least(n - p, {WINDOW}))").cast("int"))
        .withColumn("near", F.expr("slice(tokens, int(p) - before + 1, before + after)"))
        .groupBy(key, "h", "before", "after", "near")
        .agg(F.min("p").cast("int").alias("p"))
    )


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    share: float = 0.8,
) -> DataFrame:
    """doc_id, item_id, doc_start and item_start (first token of the best stretch),
    compared and matched (tokens of that stretch), and overlap, one row for each pair that
    shares a passage, best stretch first.

    Items and overlaps shorter than ``WINDOW`` tokens are compared whole; fewer than 8
    tokens are no evidence and never match. With a ``share`` under 0.8 pairs can be missed. Null texts and ids match nothing. Rows that
    repeat a doc_id or item_id count as one. No benchmark or no documents: no rows.
    """
    tokens = F.expr(_tokens("text"))
    tests = texts(benchmark, item_col, item_text_col).withColumnRenamed("doc_id", "item_id")
    tests = tests.filter("item_id IS NOT NULL").select("item_id", tokens.alias("tokens"))
    train = texts(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    train = train.select("doc_id", tokens.alias("tokens"))

    items = settled(_contexts(_seeds(tests, "item_id", False), tests, "item_id"))
    known = settled(items.select("h").distinct())
    if known.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    brief = tests.filter(F.size("tokens") < LEAST).limit(1).count() > 0
    marks = settled(_seeds(train, "doc_id", not brief).join(known, "h", "left_semi").distinct())
    hits = _contexts(marks, train, "doc_id").alias("d").join(items.alias("i"), "h")

    # What document and item have in common around the hit.
    hits = hits.withColumns(
        {"back": F.least("d.before", "i.before"), "ahead": F.least("d.after", "i.after")}
    ).select(
        "doc_id",
        "item_id",
        (F.col("d.p") - F.col("back")).alias("from_doc"),
        (F.col("i.p") - F.col("back")).alias("from_item"),
        "back",
        (F.col("back") + F.col("ahead")).alias("length"),
        F.expr(
            "zip_with(slice(d.near, d.before - back + 1, back + ahead),"
            " slice(i.near, i.before - back + 1, back + ahead),"
            " (x, y) -> if(x = y, 1, 0))"
        ).alias("same"),
    )
    hits = hits.filter("length >= 8").withColumn("width", F.least("length", F.lit(WINDOW)))
    best = F.expr(
        "array_max(transform(sequence(0, least(back, length - width)), s -> struct("
        "aggregate(slice(same, s + 1, width), 0, (a, x) -> a + x) AS matched, -s AS s)))"
    )
    # The threshold comes after the aggregate, below which it would be computed twice.
    scored = hits.withColumn("best", best)
    found = scored.groupBy("doc_id", "item_id").agg(
        F.max(
            F.struct(
                (F.col("best.matched") / F.col("width")).alias("overlap"),
                F.col("best.matched").alias("matched"),
                (F.col("best.s") - F.col("from_doc")).alias("doc"),
                (F.col("best.s") - F.col("from_item")).alias("item"),
                F.col("width").alias("compared"),
            )
        ).alias("top")
    ).filter(F.col("top.matched") >= F.ceil(F.col("top.compared") * share))
    return found.select(
        "doc_id",
        "item_id",
        (-F.col("top.doc")).cast("long").alias("doc_start"),
        (-F.col("top.item")).cast("long").alias("item_start"),
        F.col("top.compared").cast("long").alias("compared"),
        F.col("top.matched").cast("long").alias("matched"),
        F.col("top.overlap").alias("overlap"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, with all their columns, that share no passage with the benchmark."""
    found = settled(
        contaminated_pairs(docs, benchmark, id_col, text_col)
        .select(F.col("doc_id").alias("__found"))
        .distinct()
    )
    return docs.join(found, F.col(f"`{id_col}`") == F.col("__found"), "left_anti")
