"""Sets of rows in order, and sorts by several keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """(key, table, first): each key of the tables once, with the first table that has it and its least order there: one list after the other, repeats left out."""
    rows = None
    for k, t in enumerate(tables):
        part = t.select(F.col(key), F.struct(F.lit(k).alias("table"), F.col(order).alias("first")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.table", "at.first")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table that the other one lacks."""
    one = lambda x, y, side: x.select(key).distinct().join(y.select(key), key, "left_anti").withColumn("side", F.lit(side))
    return one(a, b, "left").unionByName(one(b, a, "right"))


def ranked(rows: DataFrame, *keys: Column, within: str | None = None) -> DataFrame:
    """Rows with their ``place`` in the order of several keys, in groups of ``within``. Without it, ranges of the first key are numbered one after another, so no task holds all rows."""
    if within is not None:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy(*keys)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    from graphloom.session import written

    split = written(rows.repartitionByRange(parts, *keys).withColumn("part__", F.spark_partition_id()), "ranges")
    sizes = split.groupBy("part__").agg(F.count("*").alias("n__"))  # one row a range
    before = sizes.select("part__", (F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n__")).alias("n__"))
    place = F.row_number().over(Window.partitionBy("part__").orderBy(*keys))
    return split.join(F.broadcast(before), "part__").withColumn("place", (place + F.col("n__")).cast("long")).drop("part__", "n__")
