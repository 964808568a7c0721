"""Text helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The brand phrase that store lists shorten, and its short form.
BRAND_PHRASE = "Chemist Discount Centre"
BRAND_SHORT = "CDC"


def contains_text(column: Column, term: str) -> Column:
    """Case-insensitive substring test. The term is a literal, never a pattern."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def like_pattern(term: str) -> str:
    """LIKE pattern for "contains the term". ``%`` and ``_`` in the term stay
    wildcards; a backslash is an ordinary character."""
    return "%" + term.replace("\\", "\\\\") + "%"


def any_contains(columns: list[Column], term: str) -> Column:
    """True when at least one column holds the term; null columns do not match."""
    tests = [F.coalesce(contains_text(c, term), F.lit(False)) for c in columns]
    return reduce(lambda left, right: left | right, tests)


def store_label(name: Column, store_id: Column) -> Column:
    """Store name, or ``Store <id>`` where the store table has none."""
    return F.coalesce(name, F.concat(F.lit("Store "), store_id.cast("string")))


def short_brand(name: Column) -> Column:
    """Every occurrence of the brand phrase, in any case, in its short form."""
    return F.regexp_replace(name, f"(?i){BRAND_PHRASE}", BRAND_SHORT)


def preview(text: Column, width: int = 60) -> Column:
    """The first ``width`` characters, with dots when something was cut."""
    return (
        F.when(text.isNull() | (text == ""), "N/A")
        .when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("...")))
        .otherwise(text)
    )


def file_slug(name: str) -> str:
    """A store name as part of a file name: anything but ASCII letters and digits becomes a dash."""
    return "".join(ch if ch.isascii() and ch.isalnum() else "-" for ch in name)


def letter_runs(letters: str, size: str) -> str:
    """SQL for the distinct runs of ``size`` elements of an array of letters; one empty run for size 0."""
    return (
        f"array_distinct(transform(slice(sequence(1, size({letters}) + 1), 1,"
        f" greatest(0, if({size} = 0, 1, size({letters}) - {size} + 1))),"
        f" i -> array_join(slice({letters}, i, {size}), '')))"
    )
