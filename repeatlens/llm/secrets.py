"""Secret scans: credentials by pattern, and weak parts linked with what completes them.

Positions come from built-in functions alone. ``split`` gives the gaps between the
matches of a pattern and ``regexp_extract_all`` the matches; exploded in order, running
sums of their lengths are the code point offsets. Weak candidates (identifiers, mixed
random strings, endpoints) are joined as intervals with complementary parts: within one
scope, a paragraph, and at most ``reach`` code points from the end of one to the start of the
other. The interval join is a pair of windows over (document, scope): every part sees the
largest end before it and the smallest start behind it, no pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repeatlens.llm.common import texts


@dataclass(frozen=True)
class Kind:
    """``least`` is the number of characters that ``group`` must have; ``needs`` is a cheaper
    pattern, or a plain string, without which a text has no match."""

    name: str
    pattern: str
    needs: str
    group: int = 0
    least: int = 1
    plain: bool = False


_KEY = r"(?i:password|passwd|secret|token|api_?key)"
_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""

# The base kinds, in the order in which they are listed.
BASE = (
    Kind("assign", rf"({_KEY}){_ASSIGN}([A-Za-z0-9+/_.=-]+)", _KEY + _ASSIGN, 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", "AKIA", plain=True),
    Kind("hex", r"[0-9a-f]{32,}", r"[0-9a-f]{32}"),
)
_NAME = r"(?i:\b(?:user(?:_?name)?|login|account|client_?id|(?:access_?)?key_?id))"
_SCHEME = r"(?:https?|ftp|sftp|ssh|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)"
_RANDOM = "[A-Za-z0-9+/]"
# Reported only together with what completes them.
WEAK = (
    Kind("ident", rf"{_NAME}{_ASSIGN}[A-Za-z0-9._@-]{{3,}}", _NAME + _ASSIGN),
    Kind("endpoint", rf"{_SCHEME}://[A-Za-z0-9][A-Za-z0-9.-]*(?::[0-9]+)?", "://", plain=True),
)
_LOOSE = Kind(
    "loose",
    rf"(?<!{_RANDOM})(?={_RANDOM}*[0-9])(?={_RANDOM}*[A-Z])(?={_RANDOM}*[a-z]){_RANDOM}{{20,}}={{0,2}}",
    rf"{_RANDOM}{{20}}",
)
_BREAK = Kind("break", r"\n[\x20\t]*\n", "\n", plain=True)
_ORDER = {k.name: i for i, k in enumerate((*BASE, *WEAK, _LOOSE))}


def _hits(kind: Kind, when: Column) -> Column:
    """Gaps and matches of a pattern in ``text``, in order, as an array of structs."""
    pattern = F.lit(kind.pattern)
    found = F.arrays_zip(
        F.split("text", kind.pattern, -1).alias("gap"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all("text", pattern, F.lit(kind.group)).alias("part"),
    )
    rows = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(kind.name).alias("kind"),
            i.cast("long").alias("nth"),
            F.char_length(x["gap"]).cast("long").alias("gap"),
            F.char_length(x["hit"]).cast("long").alias("size"),
            (F.char_length(x["part"]) >= kind.least).alias("valid"),
        ),
    )
    # The last gap has no match behind it.
    return F.when(when, F.filter(rows, lambda x: x["size"].isNotNull()))


def _may_have(kind: Kind) -> Column:
    return F.col("text").contains(kind.needs) if kind.plain else F.col("text").rlike(kind.needs)


def secret_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 300
) -> DataFrame:
    """One row for each document: ``doc_id`` and ``found``, an array of (start, rank, kind,
    end, base) by start, then kind. Offsets count code points, ends are exclusive.

    Null and empty texts, and texts whose matches are all too short, have no spans. Repeated rows are scanned apart and stay apart; a
    null id stays null. Texts of any length are scanned whole.
    """
    flags = {k.name: _may_have(k) for k in (*BASE, *WEAK)}
    rows = texts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({f"may_{n}": c for n, c in flags.items()})
    partner = F.col("may_ident") | F.col("may_endpoint")
    linked = partner | F.col("may_access")
    kinds = [_hits(k, F.col(f"may_{k.name}")) for k in (*BASE, *WEAK)]
    kinds += [_hits(_LOOSE, linked & _may_have(_LOOSE)), _hits(_BREAK, linked & _may_have(_BREAK))]
    none = F.array().cast(
        "array<struct<kind:string,nth:bigint,gap:bigint,size:bigint,valid:boolean>>"
    )
    each = rows.select(
        "row", "doc_id", F.explode_outer(F.concat(*(F.coalesce(k, none) for k in kinds))).alias("h")
    ).select("row", "doc_id", "h.*")

    in_order = Window.partitionBy("row", "kind").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(in_order))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    # A match that is too short becomes a row without one, so its document stays.
    kept = placed.withColumns(
        {c: F.when(F.col("valid"), F.col(c)) for c in ("kind", "start", "end")}
    )

    is_base = F.col("kind").isin([k.name for k in BASE])
    so_far = Window.partitionBy("row").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    scoped = kept.withColumns(
        {
            "scope": F.sum((F.col("kind") == "break").cast("int")).over(so_far),
            "covered": F.max(F.when(is_base, F.col("end"))).over(so_far),
        }
    )
    # Both frames hold the parts of equal start; a frame to the last row would be quadratic.
    inside, frame = Window.partitionBy("row", "scope"), (Window.unboundedPreceding, Window.currentRow)
    before = inside.orderBy("start").rangeBetween(*frame)
    behind = inside.orderBy(F.desc("start")).rangeBetween(*frame)
    covered = F.coalesce((F.col("kind") == "loose") & (F.col("covered") > F.col("start")), F.lit(False))

    def around(*names: str) -> Column:
        counts = F.col("kind").isin(*names) & ~covered
        left = F.col("start") - F.max(F.when(counts, F.col("end"))).over(before)
        right = F.min(F.when(counts, F.col("start"))).over(behind) - F.col("end")
        return F.coalesce(F.least(left, right) <= reach, F.lit(False))

    seen = scoped.withColumns(
        {
            "has_id": around("access", "ident"),
            "has_secret": around("assign", "hex", "loose"),
            "has_end": around("endpoint"),
        }
    )
    complete = (
        F.when(F.col("kind") == "ident", F.col("has_secret"))
        .when(F.col("kind") == "loose", ~covered & (F.col("has_id") | F.col("has_end")))
        .when(F.col("kind") == "endpoint", F.col("has_secret") & F.col("has_id"))
        .otherwise(False)
    )
    rank = F.create_map(*(F.lit(x) for pair in _ORDER.items() for x in pair))
    span = F.struct(
        "start",
        F.element_at(rank, F.col("kind")).alias("rank"),
        "kind",
        "end",
        is_base.alias("base"),
    )
    report = F.col("kind").isNotNull() & (F.col("kind") != "break") & (is_base | complete)
    return (
        seen.groupBy("row", "doc_id")
        .agg(F.sort_array(F.collect_list(F.when(report, span))).alias("found"))
        .select("doc_id", "found")
    )


def secret_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 300
) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans, both as
    ``kind:start:end`` joined by commas."""

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    found = secret_spans(docs, id_col, text_col, reach)
    counts = {f"n_{k.name}": count(k.name) for k in BASE}
    base = F.filter("found", lambda s: s["base"])
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
