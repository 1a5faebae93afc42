"""Streams of changed files: parsed as they arrive, each batch replacing what its files gave before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n) in tumbling windows; events that come later than ``late`` after the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def upsert_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write rows (file, ...) of each micro-batch under its batch number; ``latest`` reads the newest rows of each file. A batch that runs again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The rows of each file's newest batch."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["file", "batch"], "left_semi").drop("batch")
