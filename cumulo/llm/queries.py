"""The queries that apply the corpus operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, codebook, langid, minhash, near_vectors, ogg, packing, phrases, quality, secret_scan, toxicity, warc
from .common import read_table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(read_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(read_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.write_media(read_table(spark, sf_dir, "documents")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(read_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(read_table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebook.compress(read_table(spark, sf_dir, "embeddings"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link(read_table(spark, sf_dir, "embeddings"))


#: The queries, by the numbers of their operators.
ALL = (
    op1_bpe, op2_secrets, op3_toxicity, op4_minhash, op5_langid, op6_packing, op7_warc, op8_ogg, op9_ann, op10_quality,
    op11_phrases, op12_codes, op13_near_vectors,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secrets": secret_scan.oracle_sql(), "op7_warc": warc.oracle_sql(), "op11_phrases": phrases.oracle_sql(),
        "op12_codes": codebook.oracle_sql(), "op13_near_vectors": near_vectors.oracle_sql(),
    }
