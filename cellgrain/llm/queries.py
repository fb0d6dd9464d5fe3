"""The thin queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, licenses, mixing, ngram_join, pii, secrets, toxicity, url_filter
from .common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(documents(spark, sf_dir), keep="max")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(documents(spark, sf_dir)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stand_in_path(text: Column, doc_id: Column) -> Column:
    """A path for a table without paths: source/lang/ten thousands of the id/thousands of the id/name.

    Of the documents that bear a licence's words, those whose id ends in 0 are the licence files of the upper of the two directories
    of numbers, those whose id ends in 5 of the lower one; all others are texts named by their id. So the paths hold licence files on
    two levels, directories without one of their own, and directories with none above them.
    """
    bears, last = F.coalesce(text.rlike(licenses.TRIGGER), F.lit(False)), F.pmod(doc_id, F.lit(10))
    upper, lower = F.floor(doc_id / 10_000).cast("string"), F.floor(doc_id / 1000).cast("string")
    name = F.when(bears & last.isin(0, 5), F.lit("LICENSE")).otherwise(F.concat(doc_id.cast("string"), F.lit(".txt")))
    return F.concat_ws("/", "source", "lang", upper, F.when(~(bears & (last == 0)), lower), name)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, stand_in_path(F.col("text"), F.col("doc_id")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.taken(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (out["times"] * out["size"]).alias("taken"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_ngram_join": op2_ngram_join,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_secrets": op4_secrets,
    "op5_fingerprints": op5_fingerprints,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE}
