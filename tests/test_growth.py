"""What is shuffled grows no faster than the input, and results stay whole."""

import random

from pyspark.sql import functions as F

from graphloom import session
from graphloom.operators import evidence, traverse


def shuffled(spark, run):
    """(result of ``run``, records that its stages wrote for shuffles)."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        empty = jvm.java.util.ArrayList
        stages = sc.statusStore().stageList(empty(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), empty())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    got = run()
    return got, total() - before


def test_scopes_share_comparisons(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(f"h{draw.randrange(5)}", f"f{f:03}", f"n{f}.{draw.randrange(4 if f % 7 else 30)}") for f in range(60) for _ in range(draw.randrange(1, 40 if f % 9 else 3))]
    rows += [(None, "f001", "x"), ("h1", None, "y"), ("h1", "f002", None), ("alone", "f900", "z"), ("h1", "f901", "w")]
    ix = spark.createDataFrame(rows, "hash string, file string, id string")
    for crowd, k in ((10_000, 4), (3, 1)):
        monkeypatch.setattr(evidence, "CROWD", crowd)
        one = evidence.structurally_similar(ix, ix.select("file").distinct(), k)
        assert sorted(map(str, evidence.structurally_similar_each(ix, k).select(*one.columns).collect())) == sorted(map(str, one.collect()))


def test_copies_of_files_are_not_compared_anew(spark):
    # 31 sets of hashes; a file has a place for each hash of its own
    ix = spark.range(31 * 40).select((F.col("id") % 31 + 1).alias("s"), F.col("id").cast("string").alias("file")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("shiftright(s, h) % 2 = 1")
    ix = ix.select(F.concat(F.lit("h"), "h").alias("hash"), "file", F.concat_ws(".", "file", "h").alias("id")).localCheckpoint()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        got, records = shuffled(spark, lambda: evidence.structurally_similar_each(ix, 3).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert len(got) == 31 * 40 * 3
    assert records < 8 * ix.count()


def test_edges_are_walked_in_bounded_partitions(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    rows = [(a, a * 7 % 150) for a in range(1000)] * 2 + [(None, 3), (4, None)]
    edges, seeds = spark.createDataFrame(rows, "src long, dst long"), spark.createDataFrame([(9,)], "id long")
    parts, make = [], traverse.written

    def watched(df, name="step"):
        parts.append((name, df.rdd.getNumPartitions()))
        return make(df, name)

    near = {9}
    for _ in range(2):
        near |= {b for a, b in rows if a in near} | {a for a, b in rows if b in near}
    near -= {None}
    want = sorted((a, b) for a, b in rows if a in near and b in near)
    for most in (1_000_000, 0):
        monkeypatch.setattr(traverse, "written", watched)
        monkeypatch.setattr(traverse, "BROADCAST_IDS", most)
        assert sorted(map(tuple, traverse.subgraph(edges, seeds).collect())) == want and len(want) > 20
        assert [n for name, n in parts if name == "steps"] == [21]
        parts.clear()


def test_pairs_are_scored_where_they_are_found(spark):
    odd = [[0.0, 0.0], [1.0, None], None, [], [1.0], [float("nan"), 1.0], [float("inf"), 1.0], [3.0, 4.0], [-3.0, 0.1], [0.2, 0.7]]
    v = spark.createDataFrame([(k, odd[k % 10]) for k in range(30)] + [(4, [2.0, 1.0]), (9, [5.0, 1.0]), (99, [1.0, 1.0]), (None, [1.0, 1.0])], "id long, vector array<float>")
    e = spark.createDataFrame([(a, (a * 3 + b) % 36) for a in range(36) for b in (1, 5)], "src long, dst long")
    got = traverse.fused_each(e, v, 2)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    rows = [sorted(map(str, x.collect())) for x in (got, traverse._fused_by_joins(e, v, 2, 0.6, 0.4))]
    assert rows[0] == rows[1] and len(rows[0]) > 100
