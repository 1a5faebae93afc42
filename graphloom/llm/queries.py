"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bestfit_packing, decontaminate, hilbert_shards, html_extract, language_ppm, ngram_join, quality_forest, toxic_segments, url_filter, warc_zstd

ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ppm.identify(_table(spark, sf_dir, "documents"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.archive(_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack(_table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


_ALL = (
    op1_language_ppm,
    op2_toxic_segments,
    op3_ngram_jaccard_join,
    op4_warc_zstd,
    op5_url_filter,
    op6_bestfit_packing,
    op7_html_extract,
    op8_hilbert_shards,
    op9_decontaminate,
    op10_quality_forest,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE["op8_hilbert_shards"] = hilbert_shards.oracle()
