"""Queries over whole graphs and tables, against brute force on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import traverse
from graphloom.plans import queries as Q


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with parts 1 to 12 and orders whose lines follow each other: a ring of three files, a longer way round, and a part without a brand."""
    d = str(tmp_path_factory.mktemp("small"))
    ways = [[1, 2, 3, 1], [4, 5, 4], [1, 4, 6, 7], [7, 1], [8, 9, 10, 8], [10, 11, 12, 3], [5, 13], [2, 7], [2, 4, 3]]
    rows = [(o, p, 1, k) for o, way in enumerate(ways) for k, p in enumerate(way)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    brand = {4: "Brand#11", 5: "Brand#11", 12: None}
    parts = [(p, brand.get(p, f"Brand#{p}"), f"T{p % 2}", f"n{p}", float(p)) for p in range(1, 13)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_name string, p_retailprice double").write.parquet(f"{d}/part.parquet")
    edges = {(a, b) for way in ways for a, b in zip(way, way[1:]) if a != b}
    return d, edges, {p: b for p, b, *_ in parts}


def test_cross_file_cycles_of_parts(spark, small):
    d, edges, file = small
    want = set()
    for k in (2, 3):
        for c in itertools.permutations(range(1, 14), k):
            if c[0] == min(c) and all((a, b) in edges for a, b in zip(c, c[1:] + c[:1])) and len({file.get(x) for x in c} - {None}) > 1:
                want.add(c)
    assert (1, 2, 3) in want and (8, 9, 10) in want and (4, 5) not in want
    got = Q.QUERIES["gr12_cross_file_cycles_parts"](spark, d).collect()
    assert sorted(tuple(r.cycle) for r in got) == sorted(want) and all(r.length == len(r.cycle) for r in got)


def reach(edges, seed, most):
    """{id: depth} by plain search."""
    out, front = {seed: 0}, [seed]
    for d in range(1, most + 1):
        front = sorted({b for a, b in edges if a in front} - set(out))
        out |= dict.fromkeys(front, d)
    del out[seed]
    return out


def test_part_graph_queries(spark, small):
    d, edges, file = small
    back = {(b, a) for a, b in edges}
    ids = sorted({x for e in edges for x in e})
    run = lambda q: Q.QUERIES[q](spark, d).collect()
    impact = set()
    for name, e in (("upstream", back), ("downstream", edges)):
        for s in ids:
            impact |= {(name, s, i, k, file[i]) for i, k in reach(e, s, 3).items() if file.get(i) and file[i] != file.get(s)}
    found = traverse.impact(*Q._each(spark, d), search=traverse.reached_each).collect()
    assert {tuple(r) for r in found} == impact and len(found) == len(impact)
    risk = {s: (sum(x[0] == "upstream" and x[3] == 1 for x in own), sum(x[0] == "upstream" and x[3] > 1 for x in own), len({x[4] for x in own})) for s in ids if (own := [x for x in impact if x[1] == s])}
    assert {r.seed: (r.direct, r.indirect, r.files) for r in run("ag22_risk_parts")} == risk
    down = [x for x in impact if x[0] == "downstream"]
    assert {(r.seed, r.file, tuple(r.ids)) for r in run("ag23_group_by_file_parts")} == {(s, f, tuple(sorted(x[2] for x in down if x[1] == s and x[4] == f))) for _, s, _, _, f in down}
    ups = {s: {i: k for i, k in reach(back, s, 3).items() if file.get(i)} for s in ids}
    breaking = {s: tuple(sorted({file[i] for i, k in up.items() if (k == 1) == one}) for one in (True, False)) for s, up in ups.items() if up}
    assert {r.symbol: (r.direct_files, r.indirect_files) for r in run("ag21_breaking_changes_parts")} == breaking
    far = {s: reach(edges, s, 99) for s in ids}
    strong = {i: sorted([i, *(x for x in far[i] if i in far[x])]) for i in ids}
    assert {r.id: r.component for r in run("gr10_strong_components_parts")} == {i: c[0] for i, c in strong.items() if len(c) > 1}
    paths = {}
    for s in ids:
        grown = [(s,)]
        while grown:
            grown = [(*p, b) for p in grown for a, b in sorted(edges) if a == p[-1] and far[s].get(b) == len(p)]
            for p in grown:
                paths.setdefault((s, p[-1]), []).append(p)
    assert [r.path for r in run("gr13_shortest_path_parts")] == [list(min(paths[1, 13]))]
    n = len(ids)
    between = {i: sum(sum(i in p[1:-1] for p in ps) / len(ps) for ps in paths.values()) / ((n - 1) * (n - 2)) for i in ids}
    assert {r.id: r.score for r in run("gr3_betweenness_parts")} == pytest.approx(between, abs=2e-6)
    assert {tuple(r) for r in run("fp6_ranking_filter_parts")} == {e for e in edges if file.get(e[0]) and file.get(e[1])}
    near = {12, *reach(edges | back, 12, 2)}
    assert {tuple(r) for r in run("gr17_subgraph_parts")} == {e for e in edges if set(e) <= near} != edges
    rank = dict.fromkeys(ids, 1 / n)
    outs = {i: [b for a, b in edges if a == i] for i in ids}
    for _ in range(100):
        lost = sum(rank[i] for i in ids if not outs[i]) / n
        rank = {i: 0.15 / n + 0.85 * (lost + sum(rank[a] / len(outs[a]) for a, b in edges if b == i)) for i in ids}
    assert {r.id: r["rank"] for r in run("gr1_pagerank_parts")} == pytest.approx(rank, abs=1e-8)
    report = run("gr16_community_report_parts")
    assert sum(r.nodes for r in report) == n and all(r.representative in rank for r in report)


def test_every_row_is_a_query(spark, monkeypatch):
    from pyspark.sql import functions as F

    from graphloom.operators import evidence, vectors

    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(k, None if k == 5 else [0.0] * 3 if k == 6 else [float(k % 4), float(k * k % 5 - 2), float(k % 3)]) for k in range(40)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    q = v.where("vector IS NOT NULL").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    got = {(r.query, r.id): r.similarity for r in vectors.nearest(v, 3, 0.2).collect()}
    all_of = {}
    for r in vectors.search(v, q, 99, 0.2).collect():
        all_of.setdefault(r.query, []).append((-round(r.similarity, 12), r.id))
    want = {(a, i): -s for a, x in all_of.items() for s, i in sorted(x)[:3]}
    assert len({a for a, _ in want}) > 30 and got == pytest.approx(want, abs=1e-9)
    ix = spark.createDataFrame([(f"h{(f * k) % 4}", f"f{f}", f"n{f}.{k % 3}") for f in range(9) for k in range(1, f + 2)], "hash string, file string, id string")
    one = evidence.structurally_similar(ix, ix.select("file").distinct(), 4).collect()
    each = evidence.structurally_similar_each(ix, 4).collect()
    assert sorted(map(tuple, each)) == sorted(map(tuple, one)) and len({r.scope for r in each}) == 9


def test_allow_list_and_globs(spark):
    from graphloom.functions import text as T

    d = spark.createDataFrame([("a.md", "`pip install x` `print(1)` `True` `langchain-core` `my_func(x)` `MyClass` `src/a-b.py` `np.run(x)` `git`")], "doc_file string, text string")
    assert {r.raw_text for r in T.doc_references(d).collect()} == {"my_func(x)", "MyClass", "src/a-b.py", "np.run(x)"}
    rule = lambda g, t: (f"---\nglobs: {g}\n---\n{t}" if g else t)
    rows = [("a", rule('"**/*.py"', "use tabs")), ("b", rule("**/*.ts, **/*.py", "use spaces")), ("c", rule("src/*.rs", "use spaces")), ("d", rule("", "spaces")), ("e", rule("lib/", "spaces"))]
    got = T.rule_conflicts(spark.createDataFrame(rows, "file string, text string"), {"indent": ["tabs", "spaces"]}).collect()
    assert sorted((r.file_a, r.file_b) for r in got) == [("a", "b"), ("a", "d"), ("a", "e")]


def test_groups_of_benchmark_items(spark, monkeypatch):
    from graphloom.llm import decontaminate

    words = "red blue green gold iron salt rain snow wind fire leaf root".split()
    items = [(k, " ".join(words[(k * j + j * j) % 12] for j in range(1, 12))) for k in range(30)]
    docs = [(k, t.replace("rain", "mist") + " and so on") for k, t in items] + [(50 + k, " ".join(t.split()[: 8 + k % 3] + ["x", "y"])) for k, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    find = lambda: sorted((r.doc_id, r.item_id, r.first_word, r.words, round(r.similarity, 9)) for r in decontaminate.leaks(d, b).collect())
    whole = find()
    monkeypatch.setattr(decontaminate, "ITEMS", 4)
    assert len(decontaminate.indexes(b)) == 8 and find() == whole and len(whole) > 20


def test_impact_of_every_twentieth_part(spark, small, tmp_path):
    """The same graph with ids four times as large, so that some are divisible by 20."""
    d, edges, file = small
    spark.read.parquet(f"{d}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") * 4).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{d}/part.parquet").withColumn("p_partkey", F.col("p_partkey") * 4).write.parquet(f"{tmp_path}/part.parquet")
    want = set()
    for name, e in (("upstream", {(b, a) for a, b in edges}), ("downstream", edges)):
        for s in (5, 10):
            want |= {(name, s * 4, i * 4, k, file[i]) for i, k in reach(e, s, 3).items() if file.get(i) and file[i] != file.get(s)}
    got = Q.QUERIES["gr20_impact_parts"](spark, str(tmp_path)).collect()
    assert want and {tuple(r) for r in got} == want and len(got) == len(want)
