"""The registered queries and the pipeline over the smallest tables."""

import tempfile
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quadrille.llm import bpe, registry, simhash

SF = "/root/testdata/sf0.001"


def rows_of(df, columns):
    return Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_gives_the_same(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        db.sql(f"CREATE VIEW {table} AS FROM read_parquet('{SF}/{table}.parquet')")
    expected = db.sql(registry.ORACLES[name])
    columns = sorted(expected.columns)
    found = registry.QUERIES[name](spark, SF)
    assert sorted(found.columns) == columns
    want = Counter(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall())
    assert rows_of(found, columns) == want


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_pipeline_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = f"{tempfile.mkdtemp()}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        if name != "tokenize":
            assert docs.columns == columns
        if name in ("quality_rules", "near_dedup"):
            assert not Counter(after) - Counter(before)
        if name == "near_dedup":
            fps = [simhash.fingerprint(x["text"]) for x in after]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(fps) for b in fps[:i])
        if name == "mix_sources":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
        if name == "tokenize":
            assert Counter((x["doc_id"], x["text"]) for x in after) == Counter((x["doc_id"], x["text"]) for x in before)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


CLASHES = ["__n_words", "n_words", "__stats", "stats", "row", "__id", "id", "__stays", "stays", "__text_hash", "text_hash", "hash", "__times", "__size", "size", "u", "__words", "__copy", "copies", "mark", "level", "target", "n_tokens", "tokens", "a.b", "c`d", "fp", "component_id", "key", "c0", "_"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for k, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("string")))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        rows = after.collect()
        assert rows and all(x[c] == f"{k}:{x['doc_id']}" for x in rows for k, c in enumerate(CLASHES)), name
    tokens = bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    renamed = [c + "_" if c in ("n_tokens", "tokens") else c for c in CLASHES]
    assert all(x[c] == f"{k}:{x['doc_id']}" for x in tokens.collect() for k, c in enumerate(renamed))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_queries_without_sql_return_every_row(spark, name):
    found = registry.QUERIES[name](spark, SF)
    key, source = ("page_id", "pages") if "page_id" in found.columns else ("doc_id", "documents")
    assert Counter(x[0] for x in found.select(key).collect()) == Counter(x[0] for x in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
