"""Vector searches in blocks of matrices, against the expression of each pair."""

import random

from pyspark.sql import functions as F

from graphloom.operators import search, vectors


def plain(v, q, k, threshold, others=True):
    """Every pair by ``cosine``."""
    pairs = v.crossJoin(q)
    if others:
        pairs = pairs.where("id <> query")
    s = pairs.select("query", "id", vectors.clipped(vectors.cosine(F.col("vector"), F.col("qv"))).alias("similarity")).where("similarity IS NOT NULL")
    return sorted(map(tuple, vectors.best_of(s, k).where(F.col("similarity") >= threshold).collect()))


def made(spark, n=300):
    r = random.Random(3)
    rows = [(k, [float(r.randint(-2, 2)) for _ in range(5)] if k % 3 else [r.random() - 0.5 for _ in range(5)], k % 4) for k in range(n)]
    rows += [(1, [1.0, 0.0, 0.0, 0.0, 0.0], 1), (n, None, 1), (n + 1, [0.0] * 5, 1), (n + 2, [1.0, 2.0], 2), (n + 3, [1.0, 2.5], 2), (n + 4, [1.0, None, 1.0, 1.0, 1.0], 2), (None, [1.0] * 5, 1), (n + 5, [float("nan")] + [1.0] * 4, 3), (n + 6, [], 3)]
    rows += [(n + 10 + k, [2.0, 1.0, 0.0, 0.0, -1.0], k % 5) for k in range(40)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label int").repartition(3).cache()
    return v, v.where("id % 4 = 0 OR id > 290 OR id IS NULL OR id = 1").select(F.col("id").alias("query"), F.col("vector").alias("qv"), "label").cache()


def test_blocks_give_what_each_pair_gives(spark, monkeypatch):
    v, q = made(spark)
    w = v.drop("label")
    bare = q.drop("label")
    for k, threshold in ((3, 0.0), (50, 0.4), (1000, 0.0)):
        want = plain(w, bare, k, threshold)
        assert want and sorted(map(tuple, vectors.search(w, bare, k, threshold).collect())) == want
        with monkeypatch.context() as m:
            m.setattr(vectors, "BROADCAST_QUERIES", 5)
            m.setattr(vectors, "BLOCK", 30)
            m.setattr(vectors, "TILE", 2000)
            assert sorted(map(tuple, vectors.search(w, bare, k, threshold).collect())) == want
    some, few = w.where("id IS NOT NULL"), bare.where("query IS NOT NULL")
    want = plain(some, few, 4, 0.1, others=False)
    assert want and sorted(map(tuple, vectors.search(some, few, 4, 0.1, others=False).collect())) == want


def test_no_pair_is_a_row_of_a_join(spark):
    v, q = made(spark, 40)
    plan = vectors.search(v, q.drop("label"), 3, 0.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_candidates_by_a_column(spark):
    v, q = made(spark)
    v, q = v.where("id IS NOT NULL AND id <> 1"), q.where("query IS NOT NULL AND query <> 1")
    c = q.select("query", "label").join(v.select("id", "label"), "label").where("id <> query").select("query", "id")
    for k in (5, 90):
        pairs = sorted(map(tuple, search.hybrid_search(v, q.drop("label"), c, k, 0.0).collect()))
        assert pairs and sorted(map(tuple, search.hybrid_search(v, q, "label", k, 0.0).collect())) == pairs
