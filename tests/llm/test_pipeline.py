import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from repeatlens.llm import queries, toxicity
from tests.llm.cases import AWKWARD
from tests.llm.test_near_dups import _brute
from tests.llm.test_text_ops import _contaminated, _deduped

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    score = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).collect()
    toxic = {r["doc_id"] for r in score if r["score"] >= 0.5}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    lines = _deduped(rows.items())
    rows = {i: t for i, (t, n) in lines.items() if not n or t.strip()}
    rows = {i: rows[i] for i, (_, _, kept) in _brute(rows.items(), 5).items() if kept}
    gone = {d for d, _ in _contaminated(rows.items(), bench)}
    want = {i: t for i, t in rows.items() if i not in gone}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in got.values())
    for i, text in want.items():
        plain = re.sub(r"\s", "", text).lower()
        assert re.sub(r"\s", "", got[i]["decoded"]) == plain


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dups", "decontamination", "encoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def _with_nulls(df):
    """The rows and one that is null in every column."""
    return df.unionByName(df.limit(1).select(*(F.lit(None).cast(t).alias(n) for n, t in df.dtypes)))


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None if i is None else i + 1_000_000, t) for i, t in AWKWARD]
    awkward = spark.createDataFrame(rows, "doc_id long, text string")
    more = docs.unionByName(awkward, allowMissingColumns=True)
    _with_nulls(more).withColumn("kept", F.lit(None).cast("boolean")).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        _with_nulls(spark.read.parquet(f"{SF}/{name}.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect())
    plain = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    # Clean rows stay, also those without an id or a text, and as often as they were there.
    assert got == plain + Counter(i for i, _ in rows) + Counter([None])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    out = queries.QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name not in ("op4_decontamination", "op12_phrase_collocations", "op13_prefix_trie", "pipeline"):
        assert out.count() == docs.count()
    key = {"op12_phrase_collocations": "a", "op13_prefix_trie": "conv_id"}.get(name, "doc_id")
    assert dict(out.dtypes)[key] == "bigint"
