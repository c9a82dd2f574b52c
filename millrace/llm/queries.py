"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import crossparse, decontaminate, language, lines, media, packing, pii, rans, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.encode(_table(spark, sf_dir, "documents"))


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_recurring(docs, counts=True, passage=lines.PASSAGE)


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossparse.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@_query
def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's film (``media.text_movies``), read back as a media column."""
    films = media.text_movies(_table(spark, sf_dir, "documents"))
    return media.inspect(films, "doc_id", "media").withColumnRenamed("media_id", "doc_id")


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corpus_languages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))
