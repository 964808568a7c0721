"""Substring search over stored texts by their runs of letters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import letter_runs, like_pattern
from ..sources.export import stored
from .filters import matched, present

GRAM = 3  # code points of a run; shorter terms are found by runs of their own length
RAREST = 3  # runs of a term whose postings are read
TEXTS = 100_000  # texts whose postings a task sorts into a file


class TextIndex:
    """Which rows hold a term anywhere in some text columns, without scanning the texts.

    ``key`` names the columns that tell rows apart, ``columns`` those to search. Stored are

    * ``postings``: run of one to ``GRAM`` letters, id of a text that has it; a file has those of
      ``TEXTS`` texts, sorted by both, so that a run reads its row groups only, a frequent run
      lies in all files and no posting is shuffled;
    * ``runs``: how many texts have a run, which picks the ones worth reading;
    * ``texts``: every distinct text once, in lower case;
    * ``carriers``: text id and key of the rows that hold it.

    A term proposes the texts that share its rarest runs; these are then compared with the
    term itself, so results are those of a scan. Rows with a null in the key are never found,
    null texts hold nothing, and an empty text holds only the empty term.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: list[str]):
        self.spark, self.path, self.key, self.columns = spark, path, list(key), list(columns)

    def add(self, df: DataFrame) -> TextIndex:
        """Adds the rows of ``df`` (unlike keys and texts only). One writer at a time.

        Texts are written last. What a lost driver left behind is written again by the next
        call with the same rows; postings that are then there twice change no result.
        """
        held = [self._entries(df, name) for name in self.columns]
        entries = reduce(DataFrame.unionByName, held).distinct()
        carriers = entries.select("_id", *self.key)
        texts = entries.groupBy("_id").agg(F.first("_text").alias("_text"))
        if self._has("carriers"):
            carriers = carriers.join(self._read("carriers"), ["_id", *self.key], "left_anti")
        if self._has("texts"):
            texts = texts.join(self._read("texts").select("_id"), "_id", "left_anti")
        texts = stored(texts)
        dealt = texts.repartition(texts.count() // TEXTS + 1, "_id")
        letters = dealt.withColumn("_letters", F.expr("filter(split(_text, ''), x -> x != '')"))
        sizes = (F.expr(letter_runs("_letters", str(size))) for size in range(1, GRAM + 1))
        postings = letters.select(F.explode(F.concat(*sizes)).alias("_run"), "_id")
        self._append(postings, "postings", ["_run", "_id"])
        self._append(postings.groupBy("_run").agg(F.count("*").alias("_n")), "runs", ["_run"])
        self._append(carriers, "carriers", ["_id", *self.key])
        self._append(texts, "texts", ["_id"])
        return self

    def _entries(self, df: DataFrame, column: str) -> DataFrame:
        rows = present(df, *self.key).where(F.col(column).isNotNull())
        text = F.lower(F.col(column).cast("string"))
        rows = rows.select(*self.key, text.alias("_text"))
        return rows.withColumn("_id", F.substring(F.unhex(F.sha2("_text", 256)), 1, 16))

    def _has(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def _append(self, df: DataFrame, part: str, order: list[str]) -> None:
        placed = df if part == "postings" else df.repartitionByRange(*order)
        placed.sortWithinPartitions(*order).write.mode("append").parquet(f"{self.path}/{part}")

    def _proposed(self, parts: list[str]) -> DataFrame | None:
        """Ids of the texts that have the rarest runs of these parts; None without a part.
        The driver sees one row for each run of the term."""
        runs = {
            part[k : k + min(GRAM, len(part))]
            for part in parts
            for k in range(max(1, len(part) - GRAM + 1))
        }
        if not runs:
            return None
        counts = self._read("runs").where(F.col("_run").isin(sorted(runs)))
        known = {r["_run"]: r["n"] for r in counts.groupBy("_run").agg(F.sum("_n").alias("n")).collect()}
        rarest = sorted(runs, key=lambda run: (known.get(run, 0), run))[:RAREST]
        if rarest[0] not in known:
            return self._read("postings").where(F.lit(False)).select("_id")
        read = self._read("postings").where(F.col("_run").isin(rarest))
        shared = read.groupBy("_id").agg(F.collect_set("_run").alias("_runs"))
        return shared.where(F.size("_runs") == len(rarest)).select("_id")

    def keys(self, term: str, wildcards: bool = False) -> DataFrame:
        """The keys of the rows that hold ``term`` in one of the columns, in any case.

        With ``wildcards``, ``%`` and ``_`` in the term stand for any letters and any letter,
        as in ``dispense_filter``. The empty term is in every text.
        """
        folded = term.lower()
        parts = [p for p in (re.split("[%_]", folded) if wildcards else [folded]) if p]
        holds: Column = F.col("_text").like(like_pattern(folded)) if wildcards else F.contains("_text", F.lit(folded))
        texts, proposed = self._read("texts"), self._proposed(parts)
        if proposed is not None:
            texts = texts.join(proposed, "_id", "left_semi")
        found = texts.where(holds).select("_id").distinct()
        return matched(self._read("carriers"), found, ["_id"], "left_semi").select(*self.key).distinct()

    def search(self, df: DataFrame, term: str, wildcards: bool = False) -> DataFrame:
        """The rows of ``df`` whose key is found. ``df`` may hold more than was added, and hot keys."""
        return matched(df, self.keys(term, wildcards), self.key, "left_semi")
