"""The corpus pipeline: filters, near-duplicate removal, redaction and packing of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cumulo.llm import langid, minhash, packing, quality, secret_scan
from cumulo.llm.common import read_table
from cumulo.sources.storage import shared_dir

#: Near duplicates share this many percent of their word shingles; op4_minhash has a threshold of its own.
NEAR_PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network, fitted on the labels of docs, does not reject."""
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: those without letters, or about which the model is undecided, go."""
    return langid.accepted(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    return minhash.representatives(docs, NEAR_PERCENT)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets and linked credential parts replaced by their kinds."""
    return secret_scan.redact(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("language ID", keep_languages),
    ("MinHash near-dedup", keep_one_of_near_duplicates),
    ("secret scans", redact_secrets),
    ("packing", pack_tokens),
]

#: The classifiers and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, f"pipeline-{name.replace(' ', '-').lower()}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
