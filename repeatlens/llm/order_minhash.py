"""Order MinHash fingerprints of whole texts, by built-in functions only.

A text is read as overlapping pairs of words (k-mers of words, k = 2). Repeated k-mers are
numbered by occurrence, so that each (k-mer, number) is one element. Elements are hashed
once; the top bits place an element in one of ``BINS`` bins, the rest ranks it there (one
permutation instead of one for each coordinate). Of every bin the two minimal elements are
selected, put back in their order in the text and hashed as a tuple: one coordinate. Two
texts agree on a coordinate only if they share the same elements in the same order, which
follows the edit distance rather than the set of words.

All steps work on arrays of long inside a row: no explosion, no shuffle. Every lambda sees
only its own arguments, so no array is computed anew for each element. Bits of a packed
element: bin 6, rank 28, position 30 (a text has fewer than 2^30 words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import texts

BINS = 64
_POSITION = (1 << 30) - 1
_RANK = (1 << 28) - 1
_BLOCKS = 8192
_BLOCK_ROWS = 64


def _steps(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the signature of a text column. Each step is a column of its own that the next
    one uses more than once or only as an argument, so that none is evaluated twice."""
    keep = rows.columns
    n = f"size({out}_s)"
    steps = {
        "w": f"transform(split({text}, '\\\\s+'), w -> xxhash64(w))",
        "k": f"zip_with({out}_w, slice({out}_w, 2, size({out}_w)), (a, b) -> xxhash64(a, b))",
        # k-mer hash and position, sorted: equal k-mers lie together in text order.
        "s": f"sort_array(transform({out}_k, (x, i) -> (x & {~_POSITION}L) | cast(i AS bigint)))",
        # Where runs of equal k-mers begin.
        "b": f"""array_compact(transform(zip_with({out}_s, slice(concat(array(cast(NULL AS bigint)), {out}_s), 1, {n}),
            (x, p) -> p IS NULL OR shiftright(x, 30) != shiftright(p, 30)), (new, i) -> if(new, i, NULL)))""",
        # Occurrence numbers, run by run.
        "o": f"""flatten(zip_with({out}_b, concat(slice({out}_b, 2, {n}), array({n})),
            (a, z) -> sequence(0, z - a - 1)))""",
        "h": f"""sort_array(zip_with({out}_s, {out}_o, (x, o) ->
            (xxhash64(shiftright(x, 30), o) & {~_POSITION}L) | (x & {_POSITION}L)))""",
        # The two minimal elements of each bin, then in text order within the bin.
        "m": f"""sort_array(transform(array_compact(zip_with({out}_h,
            slice(concat(array(cast(NULL AS bigint), cast(NULL AS bigint)), {out}_h), 1, size({out}_h)),
            (v, p) -> if(p IS NULL OR shiftrightunsigned(p, 58) != shiftrightunsigned(v, 58), v, NULL))),
            v -> (v & {-(1 << 58)}L) | shiftleft(v & {_POSITION}L, 28) | (shiftrightunsigned(v, 30) & {_RANK}L)))""",
        "p": f"slice(concat(array(cast(NULL AS bigint)), {out}_m), 1, size({out}_m))",
        "q": f"zip_with({out}_m, slice({out}_m, 2, size({out}_m)), (v, z) -> struct(v AS v, z AS z))",
    }
    for name, step in steps.items():
        rows = rows.withColumn(f"{out}_{name}", F.expr(step))
    coordinate = f"""array_compact(zip_with({out}_q, {out}_p, (e, p) -> if(
        p IS NOT NULL AND shiftrightunsigned(p, 58) = shiftrightunsigned(e.v, 58), NULL,
        cast(shiftright((e.v & {-(1 << 58)}L) | shiftrightunsigned(if(
            e.z IS NOT NULL AND shiftrightunsigned(e.z, 58) = shiftrightunsigned(e.v, 58),
            xxhash64(e.v & {_RANK}L, e.z & {_RANK}L), xxhash64(e.v & {_RANK}L)), 6), 32) AS int))))"""
    return rows.withColumn(out, F.expr(coordinate)).select(*keep, out)


def likeness(a: str, b: str) -> Column:
    """Share of equal coordinates among the bins that either text fills, 0 to 1."""
    bins = "size(array_distinct(transform(concat({a}, {b}), v -> shiftrightunsigned(v, 26))))"
    return F.expr(f"size(array_intersect({a}, {b})) / {bins.format(a=a, b=b)}").cast("double")


def as_text(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, v -> lower(lpad(hex(cast(v AS bigint) & 4294967295L), 8, '0'))), '')")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, ``sig`` and ``fingerprint`` (8 hexadecimal digits a coordinate).

    Null texts count as empty. A text without words is one empty word: all such texts of
    the same kind agree. Short texts have fewer coordinates."""
    rows = _steps(texts(docs, id_col, text_col), "text", "sig")
    return rows.withColumn("fingerprint", as_text("sig"))


def with_next(rows: DataFrame, *columns: str) -> DataFrame:
    """Adds ``next_<column>`` of the row after each in ascending doc_id (nulls first, equal
    ids by text); after the last comes the first.

    Ids are cut into blocks at quantiles, at most 8192 of them, which the driver holds.
    Rows go to their block once; those at a block's lower end also go to the block before.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    total = rows.select(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).first()
    blocks = max(1, min(_BLOCKS, total["n"] // _BLOCK_ROWS))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = [] if total["n"] == 0 else [total["least"]]
    if shares:
        cuts += rows.select(F.percentile_approx(key, shares, 20 * _BLOCKS).alias("q")).first()["q"]
    cuts = sorted(set(cuts)) or [0]
    steps, step = [], 1
    while step < len(cuts):
        steps.insert(0, step)
        step *= 2
    bounds = f"cast(split('{','.join(map(str, cuts))}', ',') AS array<bigint>)"  # folds to a literal
    find = (
        f"aggregate(array({','.join(map(str, steps)) or 0}), 0, (at, s) -> "
        f"if(at + s < {len(cuts)} AND coalesce(get({bounds}, at + s), 0L) <= __key, at + s, at))"
    )
    dealt = (
        rows.withColumn("__key", key)
        .withColumn("__block", F.expr(find))
        .withColumn("__head", F.expr(f"get({bounds}, __block) = __key"))
    )
    own = F.struct(F.col("__block").alias("b"), F.lit(0).alias("wrap"), F.lit(False).alias("copy"))
    before = F.struct(
        F.when(F.col("__block") == 0, len(cuts) - 1).otherwise(F.col("__block") - 1).alias("b"),
        (F.col("__block") == 0).cast("int").alias("wrap"),
        F.lit(True).alias("copy"),
    )
    places = F.when(F.col("__head"), F.array(own, before)).otherwise(F.array(own))
    dealt = dealt.select(*rows.columns, "__key", F.explode(places).alias("__at"))
    order = Window.partitionBy("__at.b").orderBy("__at.wrap", "__key", "text")
    following = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(following).filter(~F.col("__at.copy")).drop("__key", "__at")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of every text and of its edited text: the last half of its code
    points replaced by as many first ones of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and the likeness of the
    fingerprint to the edited text's (near_edited) and to the next document's (near_next).
    Null texts count as empty; a single document is its own next; repeated rows follow each
    other; an empty table gives no rows.
    """
    signed = _steps(texts(docs, id_col, text_col), "text", "sig")
    paired = with_next(signed, "text", "sig")
    half = F.floor(F.char_length("text") / 2).cast("int")
    paired = paired.withColumn(
        "edited",
        F.concat(
            F.col("text").substr(F.lit(1), F.char_length("text") - half),
            F.col("next_text").substr(F.lit(1), half),
        ),
    ).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        "sig",
        "next_sig",
        "edited",
    )
    both = _steps(paired, "edited", "edited_sig")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"),
        as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
