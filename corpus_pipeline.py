"""The corpus pipeline over documents: each stage works on all rows that its predecessor kept.

All stages but the last return all columns of their input, whatever their names. Nulls, empty texts, repeated rows and
empty tables are treated as the operators' docstrings say: a null or wordless text does not pass the quality rules; in
the later stages such a text is linked with nothing, holds no item and no secret, and has no tokens. Of equal texts the
smallest doc_id stays; rows that repeat it stay with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from layoutspark.llm import store
from layoutspark.llm.bpe import encode_digests
from layoutspark.llm.decontam import without_leaks
from layoutspark.llm.ngram_join import keep_first
from layoutspark.llm.quality import keep_good
from layoutspark.llm.secrets_crf import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the risk-controlled thresholds reject go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity 0.8 of 5-word shingles, the smallest doc_id stays."""
    return keep_first(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or one within the edits allowed, go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the texts that are left."""
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("secret scans", secrets), ("BPE encoding and decoding", tokens)]

#: No SQL for the fitted stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store.materialize(docs, f"stage{k}")
    return docs
