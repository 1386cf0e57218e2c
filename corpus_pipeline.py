"""The corpus pipeline: quality classifier, near-dedup, decontamination, secret scans, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``. Each result is written as Parquet in the shared folder and read again, so lost executors cost one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.llm import bpe, decontaminate, quality, secretscan, simhash
from chronofold.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The stages learn from labels and keep one of each group by approximate fingerprints: SQL can't express that.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select([c for c in COLUMNS if c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labelled documents among ``docs``."""
    return quality.keep(_columns(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: sets of five-word shingles of a likeness of 0.8."""
    return simhash.one_of_each(_columns(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(_columns(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secretscan.redact(_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("secrets", redact_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
