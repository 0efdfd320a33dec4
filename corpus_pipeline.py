"""The corpus pipeline: quality rules, near-dedup, mixing, tokens.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

Defined results, beside those of the operators: a stage keeps repeated rows as its operator says
(the near-dedup keeps one of them); the mixing repeats the rows that it takes twice; columns of
documents other than its five are kept until the last stage; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import bpe, mixing, quality, simhash
from quadrille.llm.common import checkpoint_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source weights: each comes as often as the mix takes it."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the text decoded from the tokens, n_tokens and tokens."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.with_tokens(docs.select("text", "doc_id", "source"), path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: SQL has no SimHash components, certified cutoffs or byte merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to a folder of this run under the shared one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = checkpoint_folder(spark)
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
