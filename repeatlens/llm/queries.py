"""The queries of this subpackage: each operator over its whole table, and the pipeline.

``ORACLE_SQL`` has statements for operators 11 to 13. SQL cannot express the others; the
tests hold them against a brute-force version, an exact round trip or held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import sentencepiece
import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatlens.llm import (
    bpe,
    decontamination,
    language_id,
    licenses,
    line_dedup,
    near_dups,
    order_minhash,
    phrases,
    prefix_trie,
    quality,
    secrets,
    statements,
    token_counts,
    toxicity,
)
from repeatlens.llm.common import held_out, settled, table

ORACLE_SQL: dict[str, str] = {
    "op11_license_scan": statements.op11(),
    "op12_phrase_collocations": statements.OP12,
    "op13_prefix_trie": statements.OP13,
}


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = settled(quality.document_statistics(table(spark, sf_dir, "documents")))
    model = quality.fit(measured, table(spark, sf_dir, "labels"))
    return _predicted(quality.scores(measured, model), 0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    file = public_tokenizers.path("piece_bpe_32k.model")
    known = sentencepiece.SentencePieceProcessor(model_file=file)
    model = language_id.fit(docs, [known.id_to_piece(i) for i in range(known.get_piece_size())])
    return language_id.predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op7_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _predicted(toxicity.toxicity_scores(docs, model), 0.5)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", "text"
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digests(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _predicted(scores: DataFrame, limit: float) -> DataFrame:
    return scores.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_order_minhash,
        op2_bpe_transducer,
        op3_quality,
        op4_decontamination,
        op5_token_counts,
        op6_language_id,
        op7_minhash_near_dups,
        op8_toxicity,
        op9_secret_scan,
        op10_line_dedup,
        op11_license_scan,
        op12_phrase_collocations,
        op13_prefix_trie,
    )
} | {"pipeline": corpus_pipeline.run}
