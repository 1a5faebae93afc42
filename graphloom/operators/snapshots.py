"""Snapshots and differences of tables, and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(scan: DataFrame, cache: DataFrame) -> DataFrame:
    """(file, state): files (file, size, mtime, hash) against a cache: new, stale (size, or both time and hash, differ), fresh or deleted."""
    old = cache.select("file", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("hash").alias("h"), F.lit(True).alias("was"))
    j = scan.withColumn("now", F.lit(True)).join(old, "file", "full")
    differs = (F.col("size") != F.col("s")) | (F.col("mtime") != F.col("m")) & (F.col("hash") != F.col("h"))
    state = F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "new").when(differs, "stale").otherwise("fresh")
    return j.select("file", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def diff(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change, old, new): keys that were added, removed or changed."""
    c = current.select(F.col(key), F.col(value).alias("new"), F.lit(1).alias("c"))
    p = previous.select(F.col(key), F.col(value).alias("old"), F.lit(1).alias("p"))
    change = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return c.join(p, key, "full").select(key, change.alias("change"), "old", "new").where("change IS NOT NULL")


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def set_changes(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """(key, added, removed): for each key's list ``items``, what is new and what is gone."""
    c, p = current.select(key, F.col("items").alias("c")), previous.select(key, F.col("items").alias("p"))
    j = c.join(p, key, "full")
    none = F.array().cast(current.schema["items"].dataType)
    a, b = F.coalesce("c", none), F.coalesce("p", none)
    return j.select(key, F.array_sort(F.array_except(a, b)).alias("added"), F.array_sort(F.array_except(b, a)).alias("removed"))


#: What saved tables are marked with; tables of another version are not read.
VERSION = "2.0"


def save_as(df: DataFrame, path: str, version: str = VERSION) -> None:
    """Write a table with a version, over one that may be there."""
    df.withColumn("saved_version", F.lit(version)).write.mode("overwrite").parquet(path)


def load_as(spark, path: str, version: str = VERSION) -> DataFrame | None:
    """A table that ``save_as`` wrote; None if there is none, or one of another version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    df = spark.read.parquet(path)
    if "saved_version" not in df.columns or not df.where(F.col("saved_version") != version).isEmpty():
        return None
    return df.drop("saved_version")
