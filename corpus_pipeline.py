"""A training corpus from raw documents: toxic documents go, copies and near copies go, sources are mixed, texts are encoded.

Each stage takes (spark, docs, sf_dir), ``docs`` being what the stage before it
left, and returns a DataFrame; all but the last return the columns of
documents. Nulls, empty texts, repeated rows and empty tables are handled as
the operators' docstrings say: null and empty texts are scored as empty, are
one group for exact dedup and have the fingerprint zero; in the mix they have
size 0 and go as often as their source's rate says; they have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vertexloom.functions.shared import discard, scratch
from vertexloom.llm import bpe, exact_dedup, mixing, simhash, toxicity


#: Most rows and bytes of an Arrow batch. Batches hold whole texts, in the JVM and in the Python worker at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1024, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches small; settings that are smaller still stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if not (now and now.isdecimal() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted to be toxic."""
    small_batches(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    small_batches(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    small_batches(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and their token ids."""
    small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: Trained trees and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next; what no later stage reads is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as scope:
            before, docs = docs, scope.keep(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
