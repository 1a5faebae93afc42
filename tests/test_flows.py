"""Whole analyses on small fixtures."""

from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import cochange, components, flows, reports, snapshots, traverse
from graphloom.sources import scan


def test_cycles_of_any_length(spark):
    ring = [(k, (k + 1) % 7) for k in range(7)] + [(2, 0), (9, 0), (6, 8), (5, 5)]
    e = spark.createDataFrame(ring, "src long, dst long")
    found = {tuple(r.cycle) for r in components.simple_cycles(e, None).collect()}
    assert found == {(0, 1, 2), (0, 1, 2, 3, 4, 5, 6)}
    assert {tuple(r.cycle) for r in components.simple_cycles(e, 4).collect()} == {(0, 1, 2)}
    files = spark.createDataFrame([(k, "a.py" if k < 3 else "b.py") for k in range(10)], "id long, file string")
    report = flows.cycle_report(e, files, most=None).collect()
    assert [(r.place, r.length, r.files, r.total) for r in report] == [(1, 7, ["a.py", "b.py"], 1)]


def test_graphs_of_several_sources(spark):
    nodes = spark.createDataFrame([("a.py::f", "python"), ("b.ts::g", "typescript"), ("a.py", "python")], "id string, source string")
    edges = spark.createDataFrame([("a.py::f", "a.py", "in", "python", 2), ("a.py::f", "a.py", "in", "python", 1), ("b.ts::g", "x::y", "calls", "typescript", 3)], "src string, dst string, type string, source string, ord int")
    pairs = spark.createDataFrame([("a.py", "b.ts", 3), ("a.py", "c.py", 9), ("b.tsx", "d.py", 2)], "file_a string, file_b string, n int")
    ids, e = flows.merged(nodes, edges, pairs)
    assert {r.id for r in ids.collect()} == {"py:a.py::f", "ts:b.ts::g", "a.py"}
    assert {tuple(r) for r in e.collect()} == {("py:a.py::f", "a.py", "in", "python"), ("ts:b.ts::g", "ts:x::y", "calls", "typescript"), ("a.py", "b.ts", "co-occurs-cross-language", "merged"), ("b.tsx", "d.py", "co-occurs-cross-language", "merged")}
    assert {(r.file_a, r.file_b) for r in cochange.cross_language(pairs).collect()} == {("a.py", "b.ts"), ("b.tsx", "d.py")}
    assert [flows.graph_kind(*x) for x in (("python_deps.json", None, []), ("g.json", "x_ts", []), ("g.json", None, [{"from": "a.py::f"}]), ("g.json", None, [{"strength": 1}]), ("g.json", None, []))] == ["python", "typescript", "python", "cooccurrence", "unknown"]


def test_json_graphs(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a"}, {"id": "b"}], "edges": [{"source": "a", "target": "b"}, {"from": "b", "to": "a", "type": "calls"}]}')
    n, e = scan.json_graph(spark, str(tmp_path / "g.json"))
    assert n.count() == 2 and {tuple(r) for r in e.collect()} == {("a", "b", "unknown"), ("b", "a", "calls")}
    rows = flows.json_lines(n, e)
    n2, e2 = flows.from_json_lines(rows)
    assert {(r.id, r.type, r.file, r.line) for r in n2.collect()} == {("a", "unknown", "", None), ("b", "unknown", "", None)} and {tuple(r) for r in e2.collect()} == {("a", "b", "unknown", False), ("b", "a", "calls", False)}
    odd = spark.createDataFrame([("edge", '{"source": "x", "target": "y", "resolved": true}'), ("edge", '{"from": "x"}')], "kind string, value string")
    assert [tuple(r) for r in flows.from_json_lines(odd)[1].collect()] == [("x", "y", "unknown", True)]


def test_saved_versions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.load_as(spark, path) is None
    snapshots.save_as(spark.range(3), path)
    assert snapshots.load_as(spark, path).count() == 3 and snapshots.load_as(spark, path, "3.0") is None
    now = spark.createDataFrame([(1, ["a", "b"]), (3, ["z"])], "k int, items array<string>")
    old = spark.createDataFrame([(1, ["b", "c"]), (2, ["q"])], "k int, items array<string>")
    assert {(r.k, *map(tuple, (r.added, r.removed))) for r in snapshots.set_changes(now, old, "k").collect()} == {(1, ("a",), ("c",)), (2, (), ("q",)), (3, ("z",), ())}


def test_projects(spark):
    manifests = [
        ("requirements.txt", "# x\nDjango>=4\nrequests[socks]==2\n-r other.txt\n"), ("api/pyproject.toml", '[project]\ndependencies = [\n  "fastapi>=0.1",\n  "numpy",\n]\n[tool.poetry.dependencies]\npython = "^3"\nhttpx = "1"\n'),
        ("web/package.json", '{"dependencies": {"react": "18", "left-pad": "1"}, "devDependencies": {"vite": "5"}}'), ("core/Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\n[dev-dependencies]\nrand = "0.8"\n'), ("go.mod", "module x\nrequire github.com/a/b v1.2.3\n"), ("bad/package.json", "{"),
    ]
    m = spark.createDataFrame(manifests, "file string, text string")
    got = {(r.ecosystem, r.name) for r in flows.dependencies(m).collect()}
    assert got == {("python", "django"), ("python", "requests"), ("python", "fastapi"), ("python", "numpy"), ("python", "httpx"), ("javascript", "react"), ("javascript", "left-pad"), ("javascript", "vite"), ("rust", "serde"), ("rust", "rand"), ("go", "github.com/a/b")}
    names = [f for f, _ in manifests] + ["src/main.py", "tests/test_a.py", ".github/workflows/ci.yml", "web/yarn.lock", "poetry.lock"]
    files = spark.createDataFrame([(n,) for n in names], "file string").withColumn("language", T.language_of(F.col("file")))
    one = flows.project_report(files, m).first()
    assert one.monorepo and one.packages == ["api", "bad", "core", "web"] and one.frameworks == ["django", "fastapi", "react", "vite"] and one.package_managers == ["pip", "poetry", "yarn"] and one.has_ci and one.has_tests and one.entry_points == ["src/main.py"]
    nodes = spark.createDataFrame([("a", "function", "src/a.py", "a"), ("b", "function", "src/b.py", "b")], "id string, type string, file string, name string")
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "a", "calls")], "src string, dst string, type string")
    out, took = flows.quick_start(files, m, nodes, edges, spark.createDataFrame([("a", "def a")], "id string, text string"))
    assert set(out) == {"scout", "dependencies", "health", "vectors"} and out["health"].first().cycles == 1 and took.count() == 4 and took.where("total_ms < 0").count() == 0


def test_objects_by_the_order_of_types(spark):
    names = spark.createDataFrame([("q.sql", "t"), ("q.sql", "u"), ("r.sql", "t")], "file string, name string")
    objects = spark.createDataFrame([("q.sql", "view", "t", "v1"), ("q.sql", "table", "t", "t1"), ("q.sql", "index", "u", "i1")], "file string, type string, name string, id string")
    assert {(r.file, r.name, r.target, r.resolved) for r in flows.resolved_objects(names, objects, ["table", "view"]).collect()} == {("q.sql", "t", "t1", True), ("q.sql", "u", "u", False), ("r.sql", "t", "t", False)}


def test_duplicates_of_a_file(spark):
    body = "def f():\n    return 1  # one\n"
    b = spark.createDataFrame([("a.py", 1, 2, body), ("b.py", 5, 6, "def f():\n  return 1\n"), ("c.py", 1, 2, "x"), ("d.py", 1, 2, "x")], "file string, line_start int, line_end int, content string")
    assert sorted(r.places for r in flows.duplicates_of(b).collect()) == [["a.py:1:2", "b.py:5:6"], ["c.py:1:2", "d.py:1:2"]]
    (one,) = flows.duplicates_of(b, "b.py").collect()
    assert one.copies == 2 and len(one.hash) == 8


def test_documentation_report_and_suggestions(spark):
    refs = spark.createDataFrame([("d.md", 1, "inline_code", "load()", True, None), ("d.md", 2, "file_link", "a.py", False, "high")], "doc_file string, line int, ref_type string, raw_text string, found boolean, confidence string")
    symbols = spark.createDataFrame([("load",), ("save",), ("_own",), ("test_it",)], "name string")
    one = reports.docs_report(refs, symbols).first()
    assert (one.references, one.stale, one.documented, one.symbols, one.coverage) == (2, 1, 1, 2, 50.0)
    nodes = spark.createDataFrame([("py:x/util.py::go", "x/util.py", "go"), ("py:y/util.py::run", "y/util.py", "run"), ("py:z/b.py::go", "z/b.py", "go")], "id string, file string, name string")
    assert {r[0] for r in traverse.suggestions(nodes, "w/util.py").select("id").collect()} == {"py:x/util.py::go", "py:y/util.py::run"}
    assert {r[0] for r in traverse.suggestions(nodes, "none.py", "go").select("id").collect()} == {"py:x/util.py::go", "py:z/b.py::go"}
    paths = spark.createDataFrame([("See `src/a.py` and [b](docs/b.md), lib/c.rs; not https://x.io/d.py or `x`.",)], "t string").select(T.code_paths(F.col("t"))).first()[0]
    assert {"src/a.py", "docs/b.md", "lib/c.rs"} <= set(paths) and "x" not in paths


def test_source_trees_end_to_end(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("from pkg.b import go\n\ndef run():\n    return go()\n")
    (tmp_path / "pkg" / "b.py").write_text("import os\n\ndef go():\n    return os.getcwd()\n")
    (tmp_path / "pkg" / "c.pyw").write_text("x = 1\n")
    n, e = scan.graph(spark, str(tmp_path))
    assert {r.file for r in n.collect()} == {"pkg/a.py", "pkg/b.py", "pkg/c.pyw"}
    pairs = {(r.src, r.dst) for r in e.collect()}
    assert any(s.startswith("py:pkg/a.py") and d.startswith("py:pkg/b.py") for s, d in pairs)
    assert [r.language for r in reports.language_histogram(scan.files(spark, str(tmp_path)).select("file", "language")).collect()] == ["python"]
