"""Bounded samples of labelled rows, the only rows that classifiers here are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled_labels(labels: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled doc_ids, chosen by hash. A doc_id that is labelled more than once has the least of its quality labels and the greatest of its other labels; null labels don't count."""
    one = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    one = one.agg(*[(F.min(c) if c == "quality" else F.max(c)).cast("int").alias(c) for c in columns])
    for c in columns:
        one = one.where(F.col(c).isNotNull())
    return one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int, seed: int) -> DataFrame:
    """(doc_id, text, label columns) of the sampled labels, one row each; the sample is bounded, so it is broadcast. Of rows that repeat a doc_id the least text is taken."""
    picked = sampled_labels(labels, columns, rows, seed)
    found = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(c).alias(c) for c in columns])
