"""Co-change, evidence, vectors, snapshots, text functions, source scanning and streams."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import cochange, evidence, snapshots, vectors
from graphloom.sources import scan
from graphloom.streaming import ingest


def test_cochange(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (4, None)], "commit_id int, file string")
    assert [tuple(r) for r in cochange.pair_counts(c).collect()] == [("a", "b", 2)]
    assert cochange.strength(c, 2, 0.3).first().strength == pytest.approx(2 / (3 + 3 - 2))
    m = cochange.metadata(cochange.strength(c.limit(0))).first()
    assert (m.pairs, m.mean_strength, m.files) == (0, 0.0, 0)


def test_strings(spark):
    s = spark.createDataFrame([("v", f, c) for f, c in (("1", "x"), ("2", "x"), ("3", "y"))] + [("w", "1", "x")], "value string, file string, call_site string")
    f = evidence.string_files(s)
    assert [tuple(r) for r in f.collect()] == [("v", 3, 3, 2)]
    assert evidence.importance(f, s.agg(F.countDistinct("file").alias("total_files"))).first().score == 1.0
    r = spark.createDataFrame([("ab", 1), ("string", 1), ("./x/y", 1), ("flex mt-2", 1), ("fine text", 1), ("loud text", 99)], "value string, references int")
    assert {x.value: x.reason for x in evidence.filter_reasons(r, percentile=80).collect()} == {"ab": "short", "string": "type", "./x/y": "import", "flex mt-2": "css", "fine text": None, "loud text": "outlier"}


def test_code_normalisation(spark):
    a = "/* head\n more */\nint  x = 1; // one\n\n  y(\"a // b\");\n# gone"
    assert spark.createDataFrame([(a,)], "t string").select(evidence.normalized_code(F.col("t"))).first()[0] == 'int x = 1;\ny("a // b");'


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, [0.0, 0.0], "c"), (5, None, "d")], "id long, vector array<float>, label string")
    assert [(r.a, r.b) for r in vectors.near_pairs(v, 0.9, "label").collect()] == [(1, 2)]
    q = v.where("id = 1").select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    assert [r.id for r in vectors.search(v, q, 2, 0.5).collect()] == [2]
    e = vectors.encode(spark.createDataFrame([(1, "a b a"), (2, "A B a"), (3, None)], "id long, text string")).collect()
    assert e[0].vector == e[1].vector and not any(e[2].vector)


def test_snapshots(spark):
    new = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    old = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {(r.k, r.change) for r in snapshots.diff(new, old, "k", "v").collect()} == {("a", "added"), ("b", "changed"), ("c", "removed")}
    assert {tuple(r) for r in snapshots.upsert(old, new, "k").collect()} == {("a", 1), ("b", 2), ("c", 4)}
    f = "file string, size long, mtime long, hash string"
    now = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 1, 2, "x"), ("edited", 1, 2, "y"), ("new", 1, 1, "x")], f)
    was = spark.createDataFrame([("same", 1, 1, "x"), ("touched", 1, 1, "x"), ("edited", 1, 1, "x"), ("gone", 1, 1, "x")], f)
    assert {r.file: r.state for r in snapshots.stale_files(now, was).collect()} == {"same": "fresh", "touched": "fresh", "edited": "stale", "new": "new", "gone": "deleted"}


def test_text_functions(spark):
    d = spark.createDataFrame([("README.md", "See `src/a.py` and `run(x)` and `MyClass`.\n[doc](docs/x.md) [web](https://a.b/c.html)\n```python:src/b.py\ncode\n```")], "doc_file string, text string")
    refs = T.doc_references(d)
    assert {(r.line, r.ref_type, r.raw_text) for r in refs.collect()} == {(1, "file_link", "src/a.py"), (1, "function_ref", "run(x)"), (1, "class_ref", "MyClass"), (2, "markdown_link", "docs/x.md"), (3, "code_block", "src/b.py")}
    v = T.validated_references(refs, spark.createDataFrame([("src/a.py",)], "file string"), spark.createDataFrame([("run",)], "name string"))
    assert {r.raw_text for r in v.collect() if r.found} == {"src/a.py", "run(x)"}
    r = spark.createDataFrame([("rules/01-a.mdc", "---\nglobs: x\nalwaysApply: true\n---\n# T\nAlways use tabs in `src/a.py`. Prefer short names over very long names."), ("rules/01-b.mdc", "Never use tabs.")], "file string, text string")
    got = {x.file: x for x in T.rule_checks(r).collect()}
    assert got["rules/01-a.mdc"].number == 1 and got["rules/01-a.mdc"].duplicate_number and not got["rules/01-a.mdc"].untitled and got["rules/01-b.mdc"].short
    assert r.select(T.frontmatter(F.col("text")).alias("m")).first().m == {"globs": "x", "alwaysApply": "true"}
    assert [x.pattern for x in T.directive_conflicts(r).collect()] == [0]
    assert T.rule_conflicts(r, {"indent": ["tabs", "short names"]}).count() == 1
    c = T.path_coverage(r, spark.createDataFrame([("src/a.py",), ("lib/z.py",)], "path string"))
    assert {x.path: x.covered for x in c.collect()} == {"src/a.py": True, "lib/z.py": False}
    assert spark.range(1).select(T.sql_name(F.lit('Public."My Table"'))).first()[0] == "public.My Table"


SOURCES = {
    "pkg/__init__.py": "",
    "pkg/a.py": 'import os\nfrom .b import helper\nLIMIT = 3\nclass Child(Base):\n    def run(self):\n        return go("value one")\ndef go(x):\n    return x\n',
    "pkg/b.py": "class Base:\n    pass\ndef helper():\n    pass\n",
    "web/app.ts": "import { x } from './lib';\nexport class App extends Core {}\nexport function start() { boot(); }\nfunction boot() {}\n",
    "web/lib.ts": "export const x = 1;\n",
    "db/s.sql": "CREATE TABLE Users (id int);\nCREATE VIEW v AS WITH c AS (SELECT 1) SELECT * FROM users JOIN c ON 1=1;\nSELECT ';' FROM other;",
    "run.sh": "source lib.sh\nmain() {\n  step\n}\nstep() {\n  echo hi\n}\n",
    "core.rs": "use crate::util;\npub struct S;\npub fn f() { g(); }\nfn g() {}\n",
    "m.cpp": '#include "m.h"\n#define MAX_N 3\nint add(int a) {\n  return a;\n}\n',
    "bad.py": "def (:\n",
    "node_modules/x.py": "def hidden(): pass\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in SOURCES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    return str(root)


def test_scan(spark, tree):
    rows = scan.parsed(scan.files(spark, tree)).cache()
    nodes = {r.id for r in rows.where("kind = 'node'").collect()}
    assert {"py:pkg/a.py::Child", "py:pkg/a.py::LIMIT", "ts:web/app.ts::App", "sql:db/s.sql::table::users", "sql:db/s.sql::cte::1::c", "sh:run.sh::main", "rs:core.rs::S", "cpp:m.cpp::add"} <= nodes
    assert not any("hidden" in i for i in nodes)
    assert [r.file for r in rows.where("kind = 'error'").collect()] == ["bad.py"]
    e = {(r.src, r.dst, r.type) for r in scan.resolve_imports(rows).collect()}
    assert ("py:pkg/a.py", "py:pkg/b.py", "imports") in e and ("py:pkg/a.py", "py:pkg/b.py::helper", "imports_symbol") in e
    assert ("py:pkg/a.py::Child", "py:pkg/b.py::Base", "extends") in e and ("py:pkg/a.py::run", "py:pkg/a.py::go", "calls") in e
    assert ("ts:web/app.ts", "ts:web/lib.ts", "imports") in e and ("ts:web/app.ts::start", "ts:web/app.ts::boot", "calls") in e
    assert ("sql:db/s.sql::view::v", "sql:db/s.sql::table::users", "references") in e and ("sh:run.sh::main", "sh:run.sh::step", "calls") in e
    assert ("py:pkg/a.py", "os", "imports") in e
    assert {(r.value, r.call_site, r.scope) for r in scan.strings(rows).collect()} >= {("value one", "go", "run")}


def test_sql_splitter():
    assert [s for s, _ in scan.split_sql("a; b ';' ; -- c;\n d $x$ ; $x$; /* ; */ e")] == ["a", "b ';'", "-- c;\n d $x$ ; $x$", "/* ; */ e"]
    assert len(scan.split_sql("select 1;\n;select ';';")) >= 2


def test_commit_log(spark):
    lines = spark.createDataFrame(list(enumerate(["---COMMIT---", "a", "b", "", "---COMMIT---", "---COMMIT---", "c"])), "at int, line string")
    assert {tuple(r) for r in scan.commit_log(lines).collect()} == {(1, "a"), (1, "b"), (3, "c")}


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("f", 1), ("g", 1)], "file string, v int").write.parquet(src)
    stream = ingest.events_stream(spark, src, "file string, v int")
    ingest.upsert_files(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([("f", 2)], "file string, v int").write.mode("append").parquet(src)
    ingest.upsert_files(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    assert {tuple(r) for r in ingest.latest(spark, out).select("file", "v").collect()} == {("f", 2), ("g", 1)}
