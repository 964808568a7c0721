"""Ignore rules as a table, matched with error messages by a join.

``monitoring.flag_ignored_errors`` folds its rules into one expression, which is right for a
handful. Here rules are rows, read when the job runs: thousands of them meet the messages by
shared letters, and no rule is tried on a message that lacks its rarest piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import letter_runs
from .filters import matched
from .monitoring import IgnoreRule, usable_regex

RULES = "position INT, pattern STRING, description STRING, enabled BOOLEAN, is_regex BOOLEAN"
GRAM = 4  # code points of a piece; shorter patterns are one piece


def rules_table(spark: SparkSession, rules: list[IgnoreRule]) -> DataFrame:
    """Listed rules as a table, to be stored and edited."""
    rows = [(k, r.pattern, r.description, r.enabled, r.is_regex) for k, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def _folded(text: Column, case_sensitive: bool) -> Column:
    return text if case_sensitive else F.lower(text)


def flag_errors_by_table(
    errors: DataFrame, rules: DataFrame, case_sensitive: bool = False, use_regex: bool = True
) -> DataFrame:
    """The result of ``monitoring.flag_ignored_errors`` for a table of rules (``RULES``).

    The enabled rule with the least ``position`` counts, then the least pattern and
    description; substrings come before regular expressions. Every distinct message is
    matched once, however often it was logged. A pattern must share all its pieces of
    ``GRAM`` letters with a message that contains it, so it is proposed by the one piece of
    it that the fewest messages have; then the texts are compared. An empty pattern is in
    every message, a null pattern or message matches nothing.

    Regular expressions share no letters that could be joined on. They are collected and
    folded into one expression, as for listed rules: keep them few.
    """
    key = F.sha2(F.col("ErrorMessage"), 256)
    said = errors.select(key.alias("_said"), "ErrorMessage").where("_said IS NOT NULL")
    said = said.groupBy("_said").agg(F.first("ErrorMessage").alias("_message"))
    usable = rules.where("enabled AND pattern IS NOT NULL")
    found = _by_substring(said, usable.where("NOT is_regex"), case_sensitive)
    reasons = said.join(found, "_said", "left")
    if use_regex:
        by_regex = _by_regex(F.col("_message"), usable.where("is_regex"), case_sensitive)
        reasons = reasons.withColumn("_reason", F.coalesce("_reason", by_regex))
    reasons = reasons.where("_reason IS NOT NULL").select("_said", F.col("_reason").alias("IgnoreReason"))
    return (
        matched(errors.withColumn("_said", key), reasons, ["_said"], "left")
        .drop("_said")
        .withColumn("IsIgnored", F.col("IgnoreReason").isNotNull().cast("int"))
    )


def _by_substring(said: DataFrame, rules: DataFrame, case_sensitive: bool) -> DataFrame:
    """(_said, _reason) of the messages that contain a pattern."""
    order = F.struct("position", "pattern", F.coalesce("description", F.lit("")).alias("description"))
    patterns = (
        rules.select(_folded(F.col("pattern"), case_sensitive).alias("_pattern"), order.alias("_rule"))
        .groupBy("_pattern")  # the first rule of equal patterns
        .agg(F.min("_rule").alias("_rule"))
        .withColumn("_size", F.least(F.char_length("_pattern"), F.lit(GRAM)))
        .withColumn("_letters", F.expr("filter(split(_pattern, ''), x -> x != '')"))
    )
    parts = patterns.select(
        "_pattern", "_rule", "_size", F.explode(F.expr(letter_runs("_letters", "_size"))).alias("_piece")
    )
    sizes = [row["_size"] for row in patterns.select("_size").distinct().collect()]  # at most 5
    text = said.select("_said", _folded(F.col("_message"), case_sensitive).alias("_text"))
    letters = text.withColumn("_letters", F.expr("filter(split(_text, ''), x -> x != '')"))
    lists = [F.expr(letter_runs("_letters", str(size))) for size in sizes]
    every = F.concat(*lists) if lists else F.array().cast("array<string>")
    pieces = letters.select("_said", F.explode(every).alias("_piece"))

    known = pieces.join(parts.select("_piece").distinct(), "_piece", "left_semi")
    often = known.groupBy("_piece").agg(F.count("*").alias("_n"))
    rarest = (
        parts.join(often, "_piece", "left")
        .groupBy("_pattern", "_rule")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_piece")).alias("_least"))
        .where("_least.n > 0")  # a piece that no message has: the pattern is in none
        .select("_pattern", "_rule", F.col("_least._piece").alias("_piece"))
    )
    proposed = pieces.join(rarest, "_piece").select("_said", "_pattern", "_rule")
    return (
        proposed.join(text, "_said")
        .where(F.contains("_text", "_pattern"))
        .groupBy("_said")
        .agg(F.min("_rule").alias("_first"))
        .select("_said", F.col("_first.description").alias("_reason"))
    )


def _by_regex(message: Column, rules: DataFrame, case_sensitive: bool) -> Column:
    reason = F.lit(None).cast("string")
    listed = rules.orderBy("position", "pattern", "description").collect()
    for rule in reversed(listed):
        pattern = rule["pattern"] if case_sensitive else f"(?i){rule['pattern']}"
        if usable_regex(rules.sparkSession, pattern):
            reason = F.when(message.rlike(pattern), rule["description"]).otherwise(reason)
    return reason
