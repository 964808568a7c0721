"""From raw documents to encoded training text, in five stages.

Each stage takes the documents that its predecessor kept and returns a DataFrame, which
``run`` writes as Parquet and reads again for the next one. All but the last return the
columns of ``documents``.

- toxicity: documents that score 0.5 or more go.
- line_dedup: chunks of lines that occur in an earlier document go from the text; documents
  of which nothing is left go, those that were blank from the start stay.
- near_dups: of each component of near-duplicates (five-word shingles, 0.8) one document
  stays, that with the smallest doc_id.
- decontamination: documents that share a passage with the benchmark go.
- encoding: the tokens of each text, and the text that they decode to.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.llm import bpe, decontamination, line_dedup, near_dups, toxicity
from repeatlens.llm.common import table
from repeatlens.sources.export import shared_folder

VOCABULARY = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    out = line_dedup.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    out = out.filter(left)
    if "n_chars" in names:  # the length of the text as it is now
        now = F.char_length("text").cast("long")
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, now).otherwise(F.col("n_chars")))
    return out.select(*names)


def keep_one_of_near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dups.near_duplicates(docs)
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    # Stored, their size is known: few ids go to the texts, many meet them by a shuffle.
    path = shared_folder(spark, "gone")
    gone.write.parquet(path)
    gone = spark.read.schema(gone.schema).parquet(path)
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and the decoded text."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.bpe_round_trip(docs, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dups", keep_one_of_near_dups),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

# SQL cannot express these stages; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
