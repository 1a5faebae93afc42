"""Partitions of a bounded number of rows."""

from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import build, cochange
from graphloom.sources import adapters as A


def test_no_partition_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 200)
    li = spark.range(6000).select((F.col("id") % 1500).alias("l_orderkey"), (F.col("id") * 7 % 90).alias("l_partkey"), F.lit(1).alias("l_suppkey"), (F.col("id") / 1500).cast("int").alias("l_linenumber"))
    want = {}
    for x in range(6000):
        want.setdefault(x % 1500, []).append(x * 7 % 90)
    edges = A.part_edges(li)
    assert edges.rdd.getNumPartitions() == 30
    assert {tuple(r) for r in edges.collect()} == {(a, b) for w in want.values() for a, b in zip(w, w[1:]) if a != b}
    pairs = cochange.pair_counts(A.commits(li), 1)
    assert pairs.rdd.getNumPartitions() == 120
    many = {}
    for w in want.values():
        for a in set(w):
            for b in set(w):
                if a < b:
                    many[a, b] = many.get((a, b), 0) + 1
    assert {(r.file_a, r.file_b): r.n for r in pairs.collect()} == many
    last = build.kept_by(li, ["l_partkey"], F.desc("l_orderkey"))
    assert last.rdd.getNumPartitions() == 30 and last.count() == 90
