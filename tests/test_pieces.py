"""Graphs of many components, cut along them, against the whole graph in one task."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import components, pieces, rank, small, traverse


@pytest.fixture(scope="module")
def graph(spark):
    """30 components of 9 nodes, some of which have nodes without out-edges, and pairs and rings, where labels swap."""
    r = random.Random(5)
    edges = {(100 * c + r.randrange(9), 100 * c + r.randrange(9)) for c in range(30) for _ in range(14)}
    for c in range(40, 50):
        edges |= {(100 * c + k, 100 * c + (k + 1) % (4 + c % 3)) for k in range(4 + c % 3)} | {(100 * c, 100 * c + 60)}
    e = spark.createDataFrame(sorted(edges), "src long, dst long").repartition(5).cache()
    ids = sorted({x for p in edges for x in p})
    nodes = spark.createDataFrame([(i, None if i % 7 == 0 else "" if i % 11 == 0 else f"f{i % 5}") for i in ids] + [(9999, "f1")], "id long, file string").cache()
    return nodes, e


def cut_small(m):
    for name, value in (("BIN", 30), ("STEP", 20), ("SHARE", 100)):
        m.setattr(pieces, name, value)
    m.setattr(small, "AT_ONCE", 40)


def test_components_are_cut_whole(spark, graph, monkeypatch):
    _, e = graph
    cut_small(monkeypatch)
    got = pieces.cut(e)
    assert got.bins > 3 and got.edges.count() == e.count()
    assert got.nodes.groupBy("id").count().where("count > 1").isEmpty()
    monkeypatch.setattr(small, "AT_ONCE", 5)
    assert pieces.cut(e) is None


def test_solutions_of_components(spark, graph, monkeypatch):
    nodes, e = graph

    def run():
        out = [set(map(tuple, components.strongly_connected(e).collect())), set(map(tuple, components.communities(e).collect())), set(map(tuple, components.communities(e, 3).collect()))]
        out += [dict(rank.pagerank(e, rounds=9).collect()), dict(rank.pagerank(e, rounds=9, nodes=nodes.select("id")).collect())]
        return out + [dict(rank.betweenness(e).collect()), dict(rank.betweenness(e, sample=30).collect())]

    whole = run()
    cut_small(monkeypatch)
    monkeypatch.setattr(rank, "_csr", None)
    monkeypatch.setattr(components, "_spread", None)
    for a, b in zip(whole, run(), strict=True):
        assert a and (a == b if isinstance(a, set) else b == pytest.approx(a, abs=1e-13))


def test_seeds_of_components(spark, graph, monkeypatch):
    nodes, e = graph
    seeds = nodes.select("id")
    lists = lambda rows: sorted([tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in rows.collect()])
    found = traverse.impact(nodes, e, seeds)
    down = found.where("direction = 'downstream'").groupBy("seed", "file").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    want = [lists(x) for x in (found, traverse.risk(found), traverse.breaking_changes(nodes, e, seeds), down)]
    way = lambda f: [lists(f(e, seeds, d, w)) for d in (2, None) for w in ("up", "down", "both")]
    plain = way(traverse.reached)
    monkeypatch.setattr(traverse, "SEEDS_AT_ONCE", 7)
    for limit in (False, True):
        if limit:
            cut_small(monkeypatch)
            monkeypatch.setattr(traverse, "reached", None)
        assert [lists(f(nodes, e, seeds)) for f in (traverse.impact_each, traverse.risk_each, traverse.breaking_changes_each, traverse.group_by_file_each)] == want
        if limit:
            assert way(traverse.reached_each) == plain and all(plain)
