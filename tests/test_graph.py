"""Graph operators on small graphs."""

import pytest

from graphloom.operators import build, components, rank, rollup, traverse

RING = [("a", "b"), ("b", "c"), ("c", "a")]


@pytest.fixture(scope="module")
def g(spark):
    def make(edges):
        return spark.createDataFrame(edges, "src string, dst string")

    return make


@pytest.fixture(scope="module")
def ids(spark):
    return lambda *x: spark.createDataFrame([(i,) for i in x], "id string")


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_pagerank(g, ids):
    r = {x.id: x["rank"] for x in rank.pagerank(g([("a", "core"), ("b", "core"), ("c", "core"), ("d", "core"), ("e", "a")]), rounds=30).collect()}
    assert max(r, key=r.get) == "core" and r["a"] > r["e"] and abs(sum(r.values()) - 1) < 1e-9
    ring = [x["rank"] for x in rank.pagerank(g(RING), rounds=5).collect()]
    assert all(abs(x - 1 / 3) < 1e-9 for x in ring)
    assert len(rank.pagerank(g(RING), rounds=2, nodes=ids("z")).collect()) == 4
    assert rank.pagerank(g([])).count() == 0


def test_betweenness(g):
    b = {x.id: x.score for x in rank.betweenness(g([("a1", "m"), ("a2", "m"), ("m", "b1"), ("m", "b2")])).collect()}
    assert b["m"] == pytest.approx(4 / 12) and sum(v > 0 for v in b.values()) == 1
    c = {x.id: x.score for x in rank.betweenness(g([("a", "b"), ("b", "c"), ("c", "d")]), normalized=False).collect()}
    assert c == {"a": 0, "b": 2, "c": 2, "d": 0}
    assert rank.betweenness(g([])).count() == 0


def test_traversal(g, ids):
    chain = g([("a", "b"), ("b", "c"), ("c", "d"), ("d", "d")])
    assert pairs(traverse.ancestors(chain, ids("d"), 2), "id", "depth") == {("c", 1), ("b", 2)}
    assert pairs(traverse.descendants(chain, ids("a", "c"), None), "seed", "id", "depth") == {("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("c", "d", 1)}
    assert traverse.descendants(chain, ids("zz"), 3).count() == 0
    assert traverse.shortest_path(chain, "a", "d").first().path == ["a", "b", "c", "d"]
    assert traverse.shortest_path(chain, "d", "a").count() == 0
    assert pairs(traverse.subgraph(chain, ids("b"), 1), "src", "dst") == {("a", "b"), ("b", "c")}


def test_components(g, ids):
    two = g([("a", "b"), ("b", "c"), ("y", "x"), ("x", "x")])
    assert pairs(components.connected_components(two, ids("solo")), "id", "component") == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("solo", "solo")}
    assert pairs(components.strongly_connected(g([*RING, ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f")])), "id", "component") == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    assert components.strongly_connected(g([("a", "b")])).count() == 0
    assert len({x.community for x in components.communities(g([("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1")])).collect()}) == 2


def test_cycles(g, spark):
    files = spark.createDataFrame([(x, f) for x, f in zip("abcmn", ["1", "2", "3", "4", "4"])], "id string, file string")
    e = g([*RING, ("m", "n"), ("n", "m")])
    assert pairs(components.simple_cycles(e, 4), "length") == {(2,), (3,)}
    assert [x.cycle for x in components.simple_cycles(e, 4, files).collect()] == [["a", "b", "c"]]
    assert components.simple_cycles(g([("a", "b"), ("b", "c"), ("a", "c")]), 3).count() == 0


def test_build_and_merge(spark):
    nodes = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "id string, name string, ord int")
    edges = spark.createDataFrame([("a", "b", "x", 1), ("a", "b", "y", 2), ("", "b", "z", 3), ("a", None, "z", 4)], "src string, dst string, type string, ord int")
    n, e = build.build_graph(nodes, edges)
    assert pairs(n, "id", "name") == {("a", "new"), ("b", None)} and pairs(e, "src", "dst", "type") == {("a", "b", "y")}
    m, _ = build.merge_graphs([(n, e), (n.withColumn("name", n.id), e)])
    assert pairs(m, "id", "name") == {("a", "new"), ("b", None)}
    assert pairs(build.dedup_edges(edges.where("src = 'a' AND dst = 'b'")), "type") == {("x",), ("y",)}
    meta = {(r.what, r.kind): r.n for r in build.metadata(n.withColumnRenamed("name", "type"), e).collect()}
    assert meta == {("node", "*"): 2, ("node", "new"): 1, ("node", "unknown"): 1, ("edge", "*"): 1, ("edge", "y"): 1}


def test_rollups(spark, g):
    groups = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), ("x", 1)], "id string, module int")
    m = {r.module: r for r in rollup.metagraph(g([("a", "b"), ("b", "c"), ("a", "x"), ("b", "x"), ("c", "x")]), groups).collect()}
    assert m[0].cohesion == pytest.approx(0.4) and m[0].efferent == 3 and m[1].afferent == 3 and m[1].instability == 0
    nodes = spark.createDataFrame([("f1", "api/a.py"), ("f2", "services/b.py"), ("f3", "models/c.py"), ("f4", "other.py")], "id string, file string")
    layers = spark.createDataFrame([(0, "api/"), (1, "services/"), (2, "models/")], "layer_idx int, pattern string")
    placed = rollup.layers(nodes, layers)
    r = rollup.layer_report(g([("f1", "f2"), ("f2", "f3"), ("f3", "f1"), ("f4", "f1")]), placed).first()
    assert (r.total, r.violations, r.status) == (3, 1, "error")
    n = spark.createDataFrame([("u", "function", "a.py", "used"), ("v", "function", "a.py", "unused"), ("w", "function", "tests/test_a.py", "x"), ("m", "function", "a.py", "main"), ("d", "class", "a.py", "__init__")], "id string, type string, file string, name string")
    assert pairs(rollup.dead_code(n, g([("v", "u")])), "id") == {("v",)}


def test_target_lookup(spark):
    n = spark.createDataFrame([("py:src/a/request.py", "module", "src/a/request.py", "request.py"), ("py:src/b/request.py", "module", "src/b/request.py", "request.py"), ("py:x.py", "module", "x.py", "x.py"), ("py:x.py::f", "function", "x.py", "f")], "id string, type string, file string, name string")
    assert traverse.find_target(n, "./x.py") == "py:x.py" and traverse.find_target(n, "x.py", "f") == "py:x.py::f"
    assert traverse.find_target(n, "a/request.py") == "py:src/a/request.py"
    with pytest.raises(traverse.AmbiguousMatchError):
        traverse.find_target(n, "request.py")
    with pytest.raises(traverse.NoMatchError):
        traverse.find_target(n, "nothing.py")
