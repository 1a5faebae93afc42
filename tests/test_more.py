"""Reports, code, search, sets and project tables on small fixtures, and the two ways of solving graphs against each other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import code as C
from graphloom.functions import text as T
from graphloom.operators import build, components, evidence, rank, reports, search, sets, small, tools, vectors
from graphloom.sources import project as P


def graph(spark, seed, nodes=60, edges=150):
    r = random.Random(seed)
    return spark.createDataFrame([(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)] + [(200, 201), (201, 202), (202, 200), (300, 300)], "src long, dst long").distinct()


@pytest.mark.parametrize("solve", ["connected_components", "strongly_connected", "communities"])
def test_graphs_in_one_task_and_by_rounds(spark, monkeypatch, solve):
    e = graph(spark, 7).cache()
    one = set(map(tuple, getattr(components, solve)(e).collect()))
    monkeypatch.setattr(small, "AT_ONCE", 0)
    assert set(map(tuple, getattr(components, solve)(e).collect())) == one and one


def test_pagerank_in_one_task_and_by_rounds(spark, monkeypatch):
    e = graph(spark, 8).cache()
    extra = spark.createDataFrame([(900,), (901,), (3,)], "id long")
    both = {}
    for limit in (small.AT_ONCE, 0):
        monkeypatch.setattr(small, "AT_ONCE", limit)
        both[limit] = [dict(rank.pagerank(e, rounds=12, nodes=n).collect()) for n in (None, extra)]
    (a, b), (c, d) = both.values()
    assert a.keys() == c.keys() and b.keys() == d.keys() == a.keys() | {900, 901}
    assert max(abs(a[k] - c[k]) for k in a) < 1e-12 and max(abs(b[k] - d[k]) for k in b) < 1e-12 and abs(sum(b.values()) - 1) < 1e-9
    still = dict(rank.pagerank(e, tolerance=1e-9).collect())
    assert max(abs(still[k] - v) for k, v in dict(rank.pagerank(e).collect()).items()) < 1e-6


def test_strong_components_by_reachability():
    r = np.random.default_rng(2)
    for _ in range(20):
        n = 25
        src, dst = r.integers(0, n, 45), r.integers(0, n, 45)
        reach = np.eye(n, dtype=bool)
        reach[src, dst] = True
        for k in range(n):
            reach |= reach[:, [k]] & reach[[k], :]
        both = reach & reach.T
        want = [int(np.flatnonzero(both[k])[0]) if both[k].sum() > 1 else -1 for k in range(n)]
        assert small.strong(src, dst, n).tolist() == want


def test_string_ids_keep_their_order(spark):
    e = spark.createDataFrame([("b", "é"), ("é", "a"), ("x", "Z"), ("q", "q")], "src string, dst string")
    assert dict(components.connected_components(e).collect()) == {"a": "a", "b": "a", "é": "a", "x": "Z", "Z": "Z", "q": "q"}


PY = '''import os

def first(a):
    """Doc."""
    if a:
        return 1

    return 2


class Box:
    size = 1

    def grow(self):
        return 2

x = 3
'''


def test_chunks(spark):
    got = C.chunks_of("m/a.py", PY)
    assert [(c[0], c[2], c[5], c[6]) for c in got] == [("py:m/a.py::first", "function", 3, 10), ("py:m/a.py::Box", "class", 11, 13), ("py:m/a.py::grow", "function", 14, 16)]
    assert C.chunks_of("m/a.py", PY, "file")[0][:4] == ("file:m/a.py", "m/a.py", "file", "a.py") and C.chunks_of("m/a.py", "  \n") == []
    assert [c[3] for c in C.chunks_of("m/a.py", PY, "class")] == ["Box"] and C.chunks_of("a.py", "x = 1", most=3)[0][4] == "x ="
    js = "export function go(a) {\n  if (a) {\n    b();\n  }\n}\nconst add = (x) => {\n  return x;\n};\nclass A {\n}\n"
    assert [(c[3], c[2], c[5], c[6]) for c in C.chunks_of("w.ts", js)] == [("go", "function", 1, 5), ("add", "function", 6, 8), ("A", "class", 9, 10)]
    assert [(c[3], c[2]) for c in C.chunks_of("l.rs", "pub fn run() {\n}\nstruct S {\n a: i32,\n}\n")] == [("run", "function"), ("S", "class")]
    assert [(c[3], c[2], c[6]) for c in C.chunks_of("s.sql", "CREATE TABLE IF NOT EXISTS t (\n a int\n);\nselect 1;\ncreate or replace view v as\nselect 2;")] == [("t", "table", 3), ("v", "view", 6)]
    assert [c[3] for c in C.chunks_of("r.sh", "go() {\n echo 1\n}\nfunction stop {\n :\n}\n")] == ["go", "stop"]
    rows = C.chunks(spark.createDataFrame([("m/a.py", PY), ("e.md", ""), ("__init__.py", "import a\nx = 1\n"), (None, "x"), ("n.py", None)], "file string, text string")).collect()
    by = {r.id: r for r in rows}
    assert len(rows) == 4 and by["file:__init__.py"].trivial and by["py:m/a.py::first"].key == "m/a.py:3:10" and by["py:m/a.py::first"].snippet.startswith("def first(a):\n")


def test_snippets(spark):
    long = "\n\n  \n" + "\n".join(f"line {k} " + "x" * 90 for k in range(9))
    one = spark.createDataFrame([(long,), ("a\nb",), ("y" * 400,)], "t string").select(C.snippet(F.col("t"))).collect()
    assert [len(r[0].split("\n")) for r in one] == [3, 2, 1] and one[0][0].endswith("...") and one[1][0] == "a\nb" and one[2][0] == "y" * 300 + "..."


def test_duplicate_blocks(spark):
    body = "def f(a):\n    b = 1\n    c = 2\n\n    d = 3  # note\n    return d\n"
    other = body.replace("    ", "  ").replace("  # note", "") + "x = 1\n"
    assert [(b[1], b[2]) for b in C.blocks_of("a.py", "y = 0\n" + body + "z = 2\n")] == [(2, 7)] and C.blocks_of("a.py", "def f():\n  pass\n") == [] and C.blocks_of("a.txt", body) == []
    js = "function go() {\n  a();\n  b();\n  if (c) {\n  }\n}\nlet x;\n"
    assert [(b[1], b[2]) for b in C.blocks_of("a.js", js)] == [(1, 7)]
    found = C.blocks(spark.createDataFrame([("a.py", body), ("b.py", other), ("c.py", body.replace("3", "4"))], "file string, text string"))
    out = evidence.exact_duplicates(found.select(F.concat_ws(":", "file", "line_start").alias("id"), F.col("content").alias("text")).withColumn("text", evidence.normalized_code(F.col("text")))).collect()
    assert [sorted(r.ids) for r in out] == [["a.py:1", "b.py:1"]]


def test_strings_are_cleaned(spark):
    rows = spark.createDataFrame([("'it''s'", 'r#"a\\n"b"#'), ("$x$ select 1 $x$", '"a\\n\\"b\\""'), (" plain ", "c")], "s string, r string")
    got = rows.select(C.clean_sql_string(F.col("s")), C.clean_rust_string(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("it's", 'a\\n"b'), ("", 'a\n"b"'), ("plain", "c")]
    uri = spark.createDataFrame([("file:///a%20b/c+d",), ("/x y",)], "u string").select(C.path_of_uri(F.col("u"))).collect()
    assert [r[0] for r in uri] == ["/a b/c+d", "/x y"]
    assert [r[0] for r in spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 30,)], "n long").select(C.format_size(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.00 GB"]


def counting_encoder():
    def encoder(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no bad words")
        return [[float(t.count("a")), float(t.count("b")), 1.0] for t in texts]

    return encoder


def test_encoders_are_plugged_in(spark):
    encoder = counting_encoder()
    rows = [(k, "bad" if k in (3, 7) else "a" * k) for k in range(20)]
    out = {r.id: r for r in search.encoded(spark.createDataFrame(rows, "id long, text string").coalesce(1), encoder, 8).collect()}
    assert [k for k, r in out.items() if r.skipped] == [3, 7] and out[3].reason == "no bad words" and out[5].vector == [5.0, 0.0, 1.0]
    chunks = search.encoded(spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "aaab"), (4, "aaaaa")], "id long, text string"), encoder).select("id", "vector", (F.col("id") == 4).alias("trivial"))
    q = spark.createDataFrame([(1, "aaaa"), (9, "bad")], "query long, text string")
    got = search.text_search(chunks, q, encoder, 3, 0.3).orderBy("query", F.desc("similarity")).collect()
    assert [(r.query, r.id) for r in got] == [(1, 1), (1, 3), (1, 4)] and got[2].similarity < 0.51
    assert [r.id for r in search.text_search(chunks, q, encoder, 3, 0.3, spark.createDataFrame([(3,)], "id long")).collect()] == [3]


def test_searches_of_many_queries_in_blocks(spark, monkeypatch):
    r = random.Random(1)
    v = spark.createDataFrame([(k, [r.random() - 0.5 for _ in range(6)]) for k in range(120)], "id long, vector array<double>").cache()
    q = v.where("id % 3 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    one = set(map(tuple, vectors.search(v, q, 4, 0.0).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 5)
    assert set(map(tuple, vectors.search(v, q, 4, 0.0).collect())) == one and len(one) == 160
    c = q.select("query").crossJoin(v.select("id")).where("id % 2 = 0 OR query = 3").where("NOT (query = 6 AND id > 4)")
    got = search.hybrid_search(v, q, c, 4, 0.0).collect()
    assert all(x.id % 2 == 0 or x.query in (3, 6) for x in got) and {(x.query, x.id) for x in got if x.query == 6} == {(a, b) for a, b, _ in one if a == 6}


def test_store_by_scope(spark, tmp_path):
    s = search.Store(spark, f"{tmp_path}/store")
    rows = lambda ids, file, h="h": spark.createDataFrame([(i, f"{file}/{i}.py", 1, 2, h, "m", [1.0]) for i in ids], "id long, file string, line_start int, line_end int, content_hash string, model string, vector array<double>")
    s.save(rows([1, 2], "a"), "a")
    s.save(rows([3], "b"), "b")
    s.save(rows([4], "a", "new"), "a")
    assert {r.id for r in s.load().collect()} == {3, 4} and {r.id for r in s.load("m", "a/").collect()} == {4} and s.load("other").count() == 0
    assert dict(s.hashes().collect()) == {3: "h", 4: "new"} and s.without_vectors().count() == 0 and s.files().count() == 2
    s.save(rows([9], "c"), full=True)
    assert {r.id for r in s.load().collect()} == {9}


def test_path_and_refactor_reports(spark):
    n = spark.createDataFrame([("py:a.py::f", "a.py"), ("py:a.py::g", "a.py"), ("py:b.py::h", "b.py"), ("py:c.py::k", "c.py"), ("py:os", "")], "id string, file string")
    e = spark.createDataFrame([("py:b.py::h", "py:a.py::f"), ("py:c.py::k", "py:b.py::h"), ("py:a.py::g", "py:a.py::f"), ("py:a.py::f", "py:os")], "src string, dst string")
    assert [r.id for r in tools.path_report(n, e, "py:c.py::k", "py:a.py::f").orderBy("place").collect()] == ["py:c.py::k", "py:b.py::h", "py:a.py::f"]
    got = {(r.side, r.id) for r in tools.path_report(n, e, "py:a.py::f", "c.py").collect()}
    assert got == {("reason", "no edges lead from the source to the target"), ("source", "py:a.py::f"), ("target", "py:c.py::k")}
    b = spark.createDataFrame([("1", "a.py", "same"), ("2", "b.py", "same"), ("3", "b.py", "x"), ("4", "c.py", "x")], "id string, file string, text string")
    out = {(r.section, r.key): r["items"] for r in tools.refactor_report(n, e, b, "a.py").collect()}
    assert out["symbol_usage", "py:a.py::f"] == ["b.py"] and out["breaking_changes", "py:a.py::f"] == ["a.py", "b.py", "c.py"] and out["clusters", "py:a.py::f"] == ["py:a.py::f", "py:a.py::g"]
    assert [v for (s, _), v in out.items() if s == "duplicates"] == [["a.py:1", "b.py:2"]]
    near, edges = tools.around(n, e, "b.py")
    assert {r.id for r in near.collect()} == {"py:b.py::h", "py:a.py::f", "py:c.py::k"} and edges.count() == 2


def test_audit(spark):
    n = spark.createDataFrame([(f"n{k}", f"src/f{k}.py") for k in range(6)], "id string, file string")
    e = spark.createDataFrame([("n1", "n0"), ("n2", "n0"), ("n3", "n0"), ("n0", "n4"), ("n4", "n5")], "src string, dst string")
    rules = spark.createDataFrame([("r.mdc", "---\nglobs: x\n---\n# Rules\nSee `src/f0.py`, `src/gone.py`, `src/f1.ts` and `lib/none.py`.")], "file string, text string")
    out = tools.audit(n, e, rules, n.select("file"), 2)
    got = {(r.section, r.path) for r in out.collect()}
    assert ("covered", "src/f0.py") in got and {p for s, p in got if s == "stale"} == {"src/gone.py", "lib/none.py"} and not any(p == "src/f1.ts" for _, p in got)
    one = tools.audit_summary(out).first()
    assert one.hotspots == one.covered + one.gaps and one.stale == 2


def test_ordered_sets(spark):
    a, b = spark.createDataFrame([("x", 2), ("y", 1), ("x", 0)], "k string, o int"), spark.createDataFrame([("y", 0), ("z", 5)], "k string, o int")
    assert [r.k for r in sets.ordered_union([a, b], "k", "o").orderBy("table", "first").collect()] == ["x", "y", "z"]
    assert set(map(tuple, sets.symmetric_difference(a, b, "k").collect())) == {("x", "left"), ("z", "right")}
    r = sets.ranked(spark.range(100).withColumn("g", F.col("id") % 7), F.desc("g"), F.col("id")).orderBy("place").collect()
    assert [x.place for x in r] == list(range(1, 101)) and [(x.g, x.id) for x in r] == sorted(((k % 7, k) for k in range(100)), key=lambda t: (-t[0], t[1]))
    assert sets.ranked(spark.range(0), F.col("id")).count() == 0


SQL = """CREATE TABLE shop.orders ( -- all orders
  id bigint PRIMARY KEY, customer_id int NOT NULL REFERENCES customers(id), total numeric(10, 2) DEFAULT 0, note text,
  CONSTRAINT f FOREIGN KEY (note, total) REFERENCES notes (a, b), CHECK (total > 0));
create table if not exists "t2" (a int, b varchar(3) not null, primary key (a, b));"""


def test_schema_fields(spark):
    files = [
        ("m.py", "class A:\n    x: int = 1\n    y: str | None = None\n    def f(self): pass\n"), ("i.ts", "export interface U {\n  id: number;\n  name?: string;\n  at: Date | null;\n}\ntype P = { a: string }\n"),
        ("s.rs", "pub struct S<T> {\n    pub a: Vec<i32>,\n    b: Option<T>,\n}\n"), ("q.sql", SQL), ("c.json", '{"a": 1, "b": null, "c": [1], "d": {}}'), ("bad.py", "def ("), ("bad.json", "{"), ("x.txt", "a: b"),
    ]
    rows = P.schema_fields(spark.createDataFrame(files, "file string, text string"))
    got = {(r.owner, r.name): r for r in rows.collect()}
    assert (got["A", "y"].type, got["A", "y"].nullable, got["A", "x"].nullable) == ("str | None", True, False)
    assert [got["U", k].nullable for k in ("id", "name", "at")] == [False, True, True] and got["P", "a"].type == "string"
    assert got["S", "a"].type == "Vec<i32>" and got["S", "b"].nullable
    assert got["shop.orders", "id"].is_primary_key and not got["shop.orders", "id"].nullable and got["shop.orders", "customer_id"].references == "customers.id" and got["shop.orders", "total"].type == "numeric(10, 2)" and got["shop.orders", "note"].references == "notes.a"
    assert got["t2", "a"].is_primary_key and got["t2", "b"].type == "varchar(3)" and ("t2", "primary") not in got
    assert [got["c.json", k].type for k in "abcd"] == ["number", "null", "array", "object"]
    assert {(r.src, r.dst) for r in P.foreign_keys(rows).collect()} == {("shop.orders", "customers"), ("shop.orders", "notes")}


def test_path_aliases(spark):
    configs = [("tsconfig.json", '{ // base\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@ui/*": ["src/ui/*", "lib/ui/*"], "env": ["src/env.ts"],},},\n}'), ("app/tsconfig.json", '{"extends": "../tsconfig", /* own */ "compilerOptions": {}}'), ("web/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./code/*"]}}}'), ("bad/tsconfig.json", "{")]
    files = spark.createDataFrame([("src/a.ts",), ("src/ui/b.tsx",), ("lib/ui/c.ts",), ("src/env.ts",), ("web/code/a/index.ts",)], "file string")
    imports = spark.createDataFrame([("app/x.ts", "@/a"), ("app/x.ts", "@ui/b"), ("app/x.ts", "@ui/c"), ("y.ts", "env"), ("web/z.ts", "@/a"), ("y.ts", "@/none"), ("y.ts", "react")], "file string, module string")
    got = {(r.file, r.module): r.target for r in P.resolve_aliases(imports, P.alias_table(spark.createDataFrame(configs, "file string, text string")), files).collect()}
    assert got == {("app/x.ts", "@/a"): "src/a.ts", ("app/x.ts", "@ui/b"): "src/ui/b.tsx", ("app/x.ts", "@ui/c"): "lib/ui/c.ts", ("y.ts", "env"): "src/env.ts", ("web/z.ts", "@/a"): "web/code/a/index.ts"}


def test_rule_files_and_registry(spark, tmp_path):
    names = [".cursor/rules/a.mdc", ".cursor/rules/deep/b.mdc", "AGENTS.md", "docs/AGENTS.md", ".claude/rules/x/y.md", ".claude/other.md", "rules/z.md", "rules/q.txt"]
    files = spark.createDataFrame([(n, "# x") for n in names], "file string, text string")
    assert {(r.source, r.file) for r in P.discovered_rules(files).collect()} == {("cursor", names[0]), ("opencode", names[2]), ("claude", names[4])}
    assert [r.file for r in P.discovered_rules(files, ["cursor"]).collect()] == [names[0]] and [r.file for r in P.discovered_rules(files, custom="rules/").collect()] == ["rules/z.md"]
    r = P.Registry(spark, f"file://{tmp_path}/reg")
    assert r.listed().count() == 0
    for p in ("/a", "/b", "/a"):
        r.register(p, "now")
    assert sorted(x.path for x in r.listed().collect()) == ["/a", "/b"]
    h = next(x.hash for x in r.listed().collect() if x.path == "/a")
    (tmp_path / "cache" / h).mkdir(parents=True)
    (tmp_path / "cache" / h / "x").write_bytes(b"1" * 2048)
    sizes = {x.path: x["size"] for x in r.sizes(f"file://{tmp_path}/cache").collect()}
    assert sizes == {"/a": "2.0 KB", "/b": "0 B"} and r.clear(f"file://{tmp_path}/cache", "/a") and not r.clear(f"file://{tmp_path}/cache", "/a")
    assert r.unregister("/b") and not r.unregister("/b") and P.ignore_file(["b", "a", "b"]).endswith("\na\nb\n")


def test_names_of_clusters_and_noise(spark):
    names = [["parse_a", "parse_b"], ["load_x", "fetch_y", "saveZ"], ["doThing"], ["Zed"], [], ["my_fun", "other"], ["aa_x", "aa_y"]]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n array<string>").orderBy("k").select(reports.cluster_name(F.col("n"))).collect()]
    assert got == ["parse", "loading", "do", "misc", "misc", "my", "aa"]
    v = spark.createDataFrame([("TRUE",), (" \n\t",), ("h1",), ("GET",), ("plpgsql",), ("users",)], "v string")
    assert [r[0] for r in v.select(evidence.is_noise(F.col("v"))).collect()] == [True, True, True, False, True, False]
    assert [r[0] for r in v.select(evidence.is_noise(F.col("v"), language="typescript")).collect()] == [True, True, True, True, False, False]
    paths = spark.createDataFrame([("src/contests/a.py",), ("latest_b.py",), ("a_test.py",), ("x.spec.tsx",), ("src/a.py",), ("mytest_x.py",)], "p string")
    assert [r[0] for r in paths.select(build.is_test_file(F.col("p"))).collect()] == [True, True, True, True, False, True]
    assert T.EXTENSIONS["pgsql"] == "sql" and T.EXTENSIONS["c++"] == "cpp"
