"""The corpus pipeline: documents to packed training rows, one operator a stage, each stage's table written before the next one reads it.

Defined results: documents of a null, empty or wordless text go at the first stage; a null doc_id is kept through all stages and packed as null, and takes part in no group of copies;
of rows that repeat a doc_id and a text one stays from the third stage on; of copies the least doc_id stays; a document as good as a threshold stays; a document of two best languages counts as the first by name;
very long documents are read whole, and packed in pieces; an empty table gives no bins. Columns besides doc_id, text and lang are carried to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import bestfit_packing, decontaminate, language_ppm, ngram_join, quality_forest
from graphloom.session import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the isolation forest keeps."""
    return quality_forest.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that is known."""
    return language_ppm.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents."""
    return bestfit_packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and similarity search are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
