"""Registered queries of reports, code, search, sets and project tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import code as C
from graphloom.functions import text as T
from graphloom.operators import build, cochange, flows, search, sets, snapshots, tools, vectors
from graphloom.session import fixed, fresh_path, written
from graphloom.sources import adapters as A
from graphloom.sources import project as P

from .queries import _D, FX, _part_graph, _t, _vectors, query

# -- reports of rankings, paths and hierarchies

_BRANDS = f"{A.PART_EDGES}, b AS (SELECT DISTINCT x.{{0}} AS src, y.{{0}} AS dst FROM e JOIN part x ON e.src = x.p_partkey JOIN part y ON e.dst = y.p_partkey WHERE x.{{0}} <> y.{{0}})"


def _ranks(rounds: int) -> str:
    """PageRank of the graph of brands, whose ids all have out-edges or are counted as lost."""
    out = f"WITH {_BRANDS.format('p_brand')}, k AS (SELECT src, count(*) AS k FROM b GROUP BY src), ids AS (SELECT DISTINCT p_brand AS id FROM part), n AS (SELECT count(*) AS n FROM ids), p0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM ids, n)"
    for i in range(1, rounds + 1):
        out += (
            f", g{i} AS MATERIALIZED (SELECT b.dst AS id, sum(p.r / k.k) AS got FROM p{i - 1} p JOIN b ON b.src = p.id JOIN k ON k.src = p.id GROUP BY 1), l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0) AS lost FROM p{i - 1} WHERE id NOT IN (SELECT src FROM k)), "
            f"p{i} AS MATERIALIZED (SELECT ids.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + lost / n) AS r FROM ids LEFT JOIN g{i} USING (id), n, l{i})"
        )
    return out + f" SELECT CAST(row_number() OVER (ORDER BY round(r, 12) DESC, id) AS INT) AS place, id, round(round(r, 12), 6) AS importance FROM p{rounds} ORDER BY place LIMIT 20"


@query(_ranks(25))
def gr2_pagerank_report(spark, sf_dir):
    """Brands by PageRank of the graph that they collapse to. 25 rounds, after which ranks of so dense a graph don't move, so that SQL can write them out."""
    return tools.pagerank_report(*_part_graph(spark, sf_dir), level="file", rounds=25)


@query()
def gr2_pagerank_report_parts(spark, sf_dir):
    """Parts, by all 100 rounds."""
    return tools.pagerank_report(*_part_graph(spark, sf_dir))


@query()
def gr4_betweenness_report(spark, sf_dir):
    """Types of parts as the nodes, exact."""
    return tools.betweenness_report(*_part_graph(spark, sf_dir), level="package")


@query()
def gr4_betweenness_report_parts(spark, sf_dir):
    """Parts; beyond 10,000 of them from a tenth of the sources, within 100 and 500."""
    return tools.betweenness_report(*_part_graph(spark, sf_dir))


@query(
    "WITH n AS (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part), s AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM n WHERE contains(id, '12')) "
    "SELECT 'reason' AS side, 1 AS place, 'the target is no node' AS id UNION ALL SELECT 'source', CAST(place AS INT), id FROM s WHERE place <= 5"
)
def gr14_path_report(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    text = lambda c: F.col(c).cast("string").alias(c)
    return tools.path_report(n.select(text("id")), e.select(text("src"), text("dst")), "12", "no such part")


_OUTSIDE = "('py:' || list_extract(['os', 'requests', 'json', 'numpy', 'sys'], CAST(p_partkey % 5 + 1 AS INT)) || '.m' || p_partkey)"


def _with_outside(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The part graph with small parts as modules outside, without a file: standard ones and others."""
    p = _t(spark, sf_dir, "part")
    module = F.get(F.array(*map(F.lit, ["os", "requests", "json", "numpy", "sys"])), (F.col("p_partkey") % 5).cast("int"))
    outside = F.concat(F.lit("py:"), module, F.lit(".m"), F.col("p_partkey").cast("string"))
    name = F.when(F.col("p_size") <= 10, outside).otherwise(F.col("p_partkey").cast("string"))
    n = p.select("p_partkey", name.alias("id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("file"))
    e = _part_graph(spark, sf_dir)[1]
    e = e.join(n.select(F.col("p_partkey").alias("src"), F.col("id").alias("a")), "src").join(n.select(F.col("p_partkey").alias("dst"), F.col("id").alias("b")), "dst")
    return n.drop("p_partkey"), e.select(F.col("a").alias("src"), F.col("b").alias("dst"))


_OUT_NODES = f"n AS (SELECT p_partkey AS k, CASE WHEN p_size <= 10 THEN {_OUTSIDE} ELSE CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN p_size > 10 THEN p_brand END AS file, CASE WHEN p_size > 10 THEN p_brand WHEN p_partkey % 5 IN (0, 2, 4) THEN '[stdlib]' ELSE '[external]' END AS g FROM part)"


@query(f"WITH {_OUT_NODES} SELECT g AS id, count(*) AS child_count, list_sort(list(id))[1:10] AS children FROM n GROUP BY g")
def ag12_unknown_split(spark, sf_dir):
    return tools.split_unknown(_with_outside(spark, sf_dir)[0], "file")


@query(
    f"WITH {A.PART_EDGES}, {_OUT_NODES}, h AS (SELECT g, count(*) AS c FROM n GROUP BY g), u AS (SELECT DISTINCT coalesce(a.file, 'unknown') AS s, coalesce(b.file, 'unknown') AS d FROM e JOIN n a ON e.src = a.k JOIN n b ON e.dst = b.k WHERE coalesce(a.file, 'unknown') <> coalesce(b.file, 'unknown')) "
    "SELECT (SELECT count(*) FROM h) AS hierarchy_nodes, (SELECT count(*) FROM u) AS hierarchy_edges, (SELECT count(*) FROM n) AS original_nodes, round((SELECT count(*) FROM h)::DOUBLE / (SELECT count(*) FROM n), 4) AS compression, "
    "(SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM h WHERE g = '[stdlib]') AS stdlib, (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) FROM h WHERE g = '[external]') AS external"
)
def gr26_hierarchy_report(spark, sf_dir):
    return tools.hierarchy_report(*_with_outside(spark, sf_dir), "file")


@query(f"WITH {_OUT_NODES} SELECT id, starts_with(g, '[stdlib') AS standard FROM n WHERE file IS NULL")
def fp9_stdlib(spark, sf_dir):
    n = _with_outside(spark, sf_dir)[0]
    return n.where("file IS NULL").select("id", tools.is_stdlib(F.col("id")).alias("standard"))


@query()
def gr21_refactor_report(spark, sf_dir):
    """What a change of all parts of the first brand would meet; a document is a block of the file that its source names."""
    n, e = _part_graph(spark, sf_dir)
    first = n.agg(F.min("file")).first()[0]
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("source") == "src0", first).otherwise(F.col("source")).alias("file"), "text")
    return tools.refactor_report(n, written(e, "part-edges"), d, first)


@query()
def gr18_around(spark, sf_dir):
    """Edges of the part graph one step around all parts whose id holds 77."""
    n, e = _part_graph(spark, sf_dir)
    return tools.around(n, written(e, "part-edges"), "77")[1]


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_brand <> 'Brand#12') SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def gr25_smart_graph(spark, sf_dir):
    return tools.smart_graph(*_part_graph(spark, sf_dir), ["Brand#1"], ["Brand#12"])[1]


# -- snapshots, strings, documentation


_SUMMARY = "SELECT 'nodes' AS metric, count(*) AS n FROM nd UNION ALL SELECT 'files', count(DISTINCT file) FROM nd UNION ALL SELECT 'edges', count(*) FROM ed UNION ALL SELECT 'nodes:' || type, count(*) FROM nd GROUP BY type UNION ALL SELECT 'edges:' || type, count(*) FROM ed GROUP BY type"


def _order_graph(spark, sf_dir, until: str | None) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes and their lines as edges, up to a day."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    o = o if until is None else o.where(F.col("o_orderdate") < F.lit(until).cast("date"))
    nodes = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("type"), F.col("o_custkey").alias("file"))
    edges = li.join(nodes.select(F.col("id").alias("l_orderkey")), "l_orderkey").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"))
    return nodes, edges


_ORDER = "nd AS (SELECT o_orderkey AS id, o_orderstatus AS type, o_custkey AS file FROM orders{0}), ed AS (SELECT l_returnflag AS type FROM lineitem WHERE l_orderkey IN (SELECT id FROM nd))"


@query(f"WITH {_ORDER.format('')} {_SUMMARY}")
def ag2_summary_by_type(spark, sf_dir):
    return tools.graph_summary(*_order_graph(spark, sf_dir, None))


@query(
    f"SELECT metric, b.n AS before, a.n AS now, a.n - b.n AS delta FROM (WITH {_ORDER.format('')} {_SUMMARY}) a JOIN (WITH {_ORDER.format(chr(32) + 'WHERE o_orderdate < DATE ' + chr(39) + '1996-01-01' + chr(39))} {_SUMMARY}) b USING (metric) WHERE a.n <> b.n"
)
def ag44_changes_since(spark, sf_dir):
    """Against a snapshot that was saved and read again."""
    old = tools.graph_summary(*_order_graph(spark, sf_dir, "1996-01-01"))
    path = fresh_path(spark, "snapshot")
    snapshots.save(old, path)
    return tools.changes_since(*_order_graph(spark, sf_dir, None), spark.read.parquet(path))


@query(
    f"WITH {A.STRINGS}, f AS (SELECT value, count(DISTINCT file) AS files, count(*) AS r FROM s GROUP BY value HAVING count(DISTINCT file) >= 2), t AS (SELECT * FROM f ORDER BY r DESC, value LIMIT 10), u AS (SELECT DISTINCT value, call_site FROM s) "
    'SELECT value, files, r AS "references", (SELECT list_sort(list(call_site))[1:5] FROM u WHERE u.value = t.value) AS call_sites FROM t'
)
def st7_strings_report(spark, sf_dir):
    return tools.strings_report(A.page_strings(_t(spark, sf_dir, "pages")))


_REFS = "r AS (SELECT source AS doc_file, doc_id AS line, substr(text, 1, 20) AS raw_text, CASE WHEN n_chars > 2000 THEN 'high' WHEN n_chars > 800 THEN 'medium' ELSE 'low' END AS confidence, doc_id % 3 = 0 AS found FROM documents)"


@query(
    f"WITH {_REFS}, x AS (SELECT *, row_number() OVER (PARTITION BY confidence ORDER BY doc_file, line, raw_text) AS place, count(*) OVER (PARTITION BY confidence) AS total FROM r WHERE NOT found) "
    "SELECT confidence, CAST(place AS INT) AS place, doc_file, line, raw_text, total FROM x WHERE place <= CASE confidence WHEN 'low' THEN 10 ELSE 20 END"
)
def ag31_confidence_buckets(spark, sf_dir):
    level = F.when(F.col("n_chars") > 2000, "high").when(F.col("n_chars") > 800, "medium").otherwise("low")
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("doc_file"), F.col("doc_id").alias("line"), F.substring("text", 1, 20).alias("raw_text"), level.alias("confidence"), (F.col("doc_id") % 3 == 0).alias("found"))
    return tools.confidence_buckets(d)


_TREE = "t AS (SELECT DISTINCT 'src/' || p_brand || '/' || replace(p_name, ' ', '_') || '.py' AS file FROM part WHERE p_partkey % 2 = 0), every AS (SELECT file AS path FROM t UNION SELECT regexp_replace(file, '/[^/]*$', '') FROM t UNION SELECT 'src'), q AS (SELECT p_partkey AS rule, 'src/' || p_brand || '/' || CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') || '.ts' ELSE replace(p_name, ' ', '_') || CASE WHEN p_partkey % 5 = 0 THEN '_old' ELSE '' END || '.py' END AS path FROM part)"


@query(
    f"WITH {_TREE}, m AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS folder, split_part(regexp_extract(path, '([^/]*)$', 1), '.', 1) AS stem FROM q WHERE path NOT IN (SELECT path FROM every)), "
    "s AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS folder, regexp_extract(path, '([^/]*)$', 1) AS name FROM every) SELECT path, rule FROM m WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.folder = m.folder AND starts_with(s.name, m.stem))"
)
def j18_stale_references(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    files = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), name, F.lit(".py")).alias("file")).distinct()
    end = F.when(F.col("p_partkey") % 3 == 0, F.concat(name, F.lit(".ts"))).otherwise(F.concat(name, F.when(F.col("p_partkey") % 5 == 0, "_old").otherwise(""), F.lit(".py")))
    refs = p.select(F.col("p_partkey").alias("rule"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), end).alias("path"))
    return tools.missing_paths(refs, files).select("path", "rule")


# -- code, files, names


_CODE = "lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '^\\s*($|#|//|/\\*|\\*|import |from |require\\(|export \\{|export default\\s*$|\"\"\"|'''''')')) AS l FROM documents WHERE text IS NOT NULL)"


@query(f"WITH {_CODE} SELECT doc_id AS id, CAST(len(l) AS INT) AS code_lines, len(l) < 5 AS trivial FROM lines")
def fp15_trivial_chunks(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").alias("id"), C.code_lines(F.col("text")).alias("code_lines"), C.is_trivial(F.lit("a.py"), F.col("text")).alias("trivial"))


@query("SELECT 'file:' || doc_id AS id, 'file' AS type, CAST(doc_id AS VARCHAR) AS name, 1 AS line_start, CAST(len(string_split(text, chr(10))) AS INT) AS line_end, substr(sha256(text), 1, 16) AS content_hash, doc_id || ':1:' || len(string_split(text, chr(10))) AS key FROM documents WHERE regexp_matches(text, '\\S')")
def vs12_chunks(spark, sf_dir):
    """Documents as files without definitions: a chunk each, whole."""
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return C.chunks(d).select("id", "type", "name", "line_start", "line_end", "content_hash", "key")


@query(
    "SELECT doc_id AS id, CASE WHEN n_chars * 1000 < 1024 THEN printf('%d B', CAST(n_chars * 1000 AS BIGINT)) WHEN n_chars * 1000 < 1048576 THEN printf('%.1f KB', n_chars * 1000.0::DOUBLE / 1024) WHEN n_chars * 1000 < 1073741824 THEN printf('%.1f MB', n_chars * 1000.0::DOUBLE / 1048576) ELSE printf('%.2f GB', n_chars * 1000.0::DOUBLE / 1073741824) END AS size FROM documents"
)
def f21_format_size(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), C.format_size((F.col("n_chars") * 1000).cast("long")).alias("size"))


@query("SELECT page_id AS id, substr(sha256(url), 1, 16) AS hash FROM pages WHERE url IS NOT NULL")
def f22_repo_hash(spark, sf_dir):
    return _t(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("id"), P.repo_hash(F.col("url")).alias("hash"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN 'it''s ' || p_name ELSE p_name END AS value FROM part")
def f17_clean_strings(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("$body$ "), "p_name", F.lit(" $body$"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("'it''s "), "p_name", F.lit("'"))).otherwise(F.col("p_name"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), C.clean_sql_string(raw).alias("value"))


_FILES = "f AS (SELECT p_partkey AS id, 'lib/' || p_brand || list_extract(['.py', '.tsx', '.rs', '.mjs', '.c++', '.txt', '.pyw', '.test.ts', '/tests/a.py', '_test.py'], CAST(p_partkey % 10 + 1 AS INT)) AS file FROM part)"


def _file_names(spark, sf_dir) -> DataFrame:
    ends = F.array(*map(F.lit, [".py", ".tsx", ".rs", ".mjs", ".c++", ".txt", ".pyw", ".test.ts", "/tests/a.py", "_test.py"]))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("lib/"), "p_brand", F.get(ends, (F.col("p_partkey") % 10).cast("int"))).alias("file"))


@query(f"WITH {_FILES} SELECT language, CAST(place AS INT) AS place FROM (VALUES ('python', 1), ('typescript', 2), ('rust', 3), ('cpp', 7)) v(language, place) WHERE EXISTS (SELECT 1 FROM f)")
def sc5_detect_languages(spark, sf_dir):
    return P.detect_languages(_file_names(spark, sf_dir))


@query(f"WITH {_FILES} SELECT id, file, CASE WHEN id % 10 IN (0, 6, 8, 9) THEN 'python' WHEN id % 10 = 1 THEN 'tsx' WHEN id % 10 = 2 THEN 'rust' WHEN id % 10 = 3 THEN 'javascript' WHEN id % 10 = 4 THEN 'cpp' WHEN id % 10 = 7 THEN 'typescript' END AS language, id % 10 IN (7, 8, 9) AS test FROM f")
def fp8_test_files(spark, sf_dir):
    """Languages and test files by name."""
    return _file_names(spark, sf_dir).select("id", "file", T.language_of(F.col("file")).alias("language"), build.is_test_file(F.col("file")).alias("test"))


@query("SELECT unnest(list_sort(list_distinct(" + str(sorted({*P.IGNORES, *P.FRAMEWORKS["next"], *P.FRAMEWORKS["django"], *P.LANGUAGE_IGNORES["rust"]})) + "))) AS pattern")
def fp5_suggested_ignores(spark, sf_dir):
    one = spark.range(1).select(P.suggested_ignores(F.array(F.lit("Next"), F.lit("django"), F.lit("unheard")), F.array(F.lit("Rust"))).alias("p"))
    return one.select(F.explode("p").alias("pattern"))


@query(
    "WITH d AS (SELECT doc_id AS id, lang AS a, lead(lang) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) "
    "SELECT id, CASE WHEN id % 7 = 0 THEN true ELSE a = b END AS overlap FROM d WHERE a IS NOT NULL AND b IS NOT NULL"
)
def f20_globs_overlap(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("a"), F.lead("lang").over(Window.partitionBy("source").orderBy("doc_id")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    other = F.when(F.col("id") % 7 == 0, "**/*").otherwise(F.concat(F.lit("src/**/*."), "b"))
    return d.select("id", T.globs_overlap(F.concat(F.lit("*."), "a"), other).alias("overlap"))


@query("SELECT count(DISTINCT CASE WHEN o_orderdate >= DATE '1998-07-02' THEN o_orderkey END) AS recent_commits, count(DISTINCT o_custkey) AS contributors FROM orders")
def sc19_git_summary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").cast("date").alias("at"))
    return P.git_summary(o, F.lit("1998-08-01").cast("date"))


@query("SELECT DISTINCT substr(sha256(source), 1, 16) AS hash, source AS path FROM documents WHERE source IS NOT NULL")
def sk9_registry(spark, sf_dir):
    """Every source registered as a repository, one of them twice, one taken out and put back."""
    r = P.Registry(spark, fresh_path(spark, "registry"))
    names = [x[0] for x in _t(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct().orderBy("source").collect()]
    for n in [*names, names[0]]:
        r.register(n, "2020-01-01")
    assert r.unregister(names[-1]) and not r.unregister("no such")
    r.register(names[-1], "2020-01-02")
    return r.listed().select("hash", "path")


# -- sets and sorts


@query(
    "WITH a AS (SELECT o_custkey AS key, 0 AS t, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS key, 1 AS t, min(o_orderkey) AS f FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) "
    'SELECT key, t AS "table", f AS first FROM a UNION ALL SELECT key, t, f FROM b WHERE key NOT IN (SELECT key FROM a)'
)
def so2_distinct_union(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("ord"))
    return sets.ordered_union([of("F"), of("O")], "key", "ord")


@query(
    "WITH a AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'O') "
    "SELECT key, 'left' AS side FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'right' FROM b WHERE key NOT IN (SELECT key FROM a)"
)
def so5_symmetric_difference(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    return sets.symmetric_difference(of("F"), of("O"), "key")


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY p_type, p_size DESC, p_partkey) AS place FROM part")
def w9_multi_key_sort(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size")
    return sets.ranked(p, F.col("p_type"), F.col("p_size").desc(), F.col("id")).select("id", "place")


# -- search

_SIM = "greatest(0, least(1, " + _D.format("v.embedding", "q.embedding") + "))"
_BEST = "row_number() OVER (PARTITION BY q.vec_id ORDER BY " + _SIM + " DESC, v.vec_id)"


def _queries(v: DataFrame) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv"))


@query(f"WITH x AS (SELECT q.vec_id AS query, v.vec_id AS id, {_BEST} AS p FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) SELECT query, id FROM x WHERE p <= 10")
def vs11_exact_search(spark, sf_dir):
    """The ten nearest of all vectors, by inner product, for every twentieth."""
    v = _vectors(spark, sf_dir)
    return vectors.search(v, _queries(v), 10, 0.0).select("query", "id")


@query(f"WITH x AS (SELECT q.vec_id AS query, v.vec_id AS id, {_BEST} AS p FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id WHERE v.label = 1) SELECT query, id FROM x WHERE p <= 10")
def fp17_search_of_listed_ids(spark, sf_dir):
    """Only vectors of one label are searched: the list of their ids is applied before scoring."""
    v = _vectors(spark, sf_dir)
    return vectors.search(search.only(v, v.where("label = 1").select("id")), _queries(v), 10, 0.0).select("query", "id")


@query("SELECT p_partkey AS id, 'found' AS prefix FROM part WHERE starts_with(p_brand, 'Brand#1') UNION ALL SELECT p_partkey, 'missing' FROM part")
def fp16_package_prefix(spark, sf_dir):
    """A prefix that matches keeps its rows, one that matches nothing keeps all."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"))
    hit, miss = search.within(p, "Brand#1"), search.within(p, "NoBrand")
    return hit.select("id", F.lit("found").alias("prefix")).unionByName(miss.select("id", F.lit("missing").alias("prefix")))


@query(
    f"WITH c AS (SELECT q.vec_id AS query, v.vec_id AS id FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND v.label = q.label), k AS (SELECT query, count(*) AS n FROM c GROUP BY 1), "
    f"x AS (SELECT q.vec_id AS query, v.vec_id AS id, {_BEST} AS p FROM embeddings v JOIN embeddings q ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id LEFT JOIN k ON k.query = q.vec_id WHERE coalesce(k.n, 0) < 12 OR v.label = q.label) SELECT query, id FROM x WHERE p <= 12"
)
def vs6_hybrid_search(spark, sf_dir):
    """Candidates are the vectors of the query's label; a query with fewer than twelve searches all."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("vector").alias("qv"), "label")
    return search.hybrid_search(v, q, "label", 12, 0.0).select("query", "id")


@query()
def vs2_text_search(spark, sf_dir):
    """Every document whose id is divisible by 20 as a query against all documents, by the stand-in encoder."""
    d = _t(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    v = written(vectors.encode(d.select(F.col("doc_id").alias("id"), "text")), "encoded")
    found = search.text_search(v, d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"), k=11, threshold=0.3)
    return found.where("query <> id").withColumn("similarity", fixed(F.col("similarity"), 4))


@query("SELECT label AS scope, count(*) AS chunks, count(DISTINCT vec_id % 100) AS files FROM embeddings GROUP BY label")
def sk6_scoped_store(spark, sf_dir):
    """Vectors saved scope by scope, the first two scopes twice, and all read again."""
    v = _vectors(spark, sf_dir)
    rows = v.select("id", F.concat_ws("/", F.col("label").cast("string"), (F.col("id") % 100).cast("string")).alias("file"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash"), F.lit("words").alias("model"), "vector", "label")
    s = search.Store(spark, fresh_path(spark, "store"))
    labels = sorted(x[0] for x in v.select("label").distinct().collect())  # scopes are few
    for n in [*labels[:2], *labels]:
        s.save(rows.where(F.col("label") == n).drop("label"), str(n))
    return s.load("words").groupBy(F.split("file", "/")[0].cast("long").alias("scope")).agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"))





# -- whole analyses


@query(
    f"WITH {A.PART_EDGES}, g AS (SELECT 'a.py::' || src AS src, 'a.py::' || dst AS dst, 'follows' AS type, 'python' AS source FROM e UNION ALL SELECT 'b.ts::' || l_suppkey, 'lib/' || l_partkey, l_returnflag, 'typescript' FROM lineitem), "
    "p AS (SELECT DISTINCT CASE WHEN source = 'python' THEN 'py:' || src ELSE 'ts:' || src END AS src, CASE WHEN source = 'python' THEN 'py:' || dst ELSE dst END AS dst, type, source FROM g), "
    "s AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), w AS (SELECT a.f AS a, b.f AS b FROM s a JOIN s b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2) "
    "SELECT src, dst, type, source FROM p UNION ALL SELECT CASE WHEN a % 2 = 0 THEN a || '.py' ELSE a || '.ts' END, CASE WHEN b % 2 = 0 THEN b || '.py' ELSE b || '.ts' END, 'co-occurs-cross-language', 'merged' FROM w WHERE a % 2 <> b % 2"
)
def ag39_merge_sources(spark, sf_dir):
    """Parts as symbols of Python, suppliers as those of TypeScript, and joint changes between files of both."""
    li = _t(spark, sf_dir, "lineitem")
    name = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    a = A.part_edges(li).select(name("a.py::", "src").alias("src"), name("a.py::", "dst").alias("dst"), F.lit("follows").alias("type"), F.lit("python").alias("source"))
    b = li.select(name("b.ts::", "l_suppkey").alias("src"), name("lib/", "l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.lit("typescript").alias("source"))
    e = a.unionByName(b).withColumn("ord", F.lit(0))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "source")
    file = lambda c: F.concat(F.col(c).cast("string"), F.when(F.col(c) % 2 == 0, ".py").otherwise(".ts"))
    pairs = cochange.pair_counts(A.commits(li)).select(file("file_a").alias("file_a"), file("file_b").alias("file_b"))
    return flows.merged(ends, e, pairs)[1]


_STRENGTH = (
    "s AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2), "
    "k AS (SELECT l_partkey AS f, count(*) AS k FROM lineitem GROUP BY 1), t AS (SELECT file_a, file_b, n, n::DOUBLE / (x.k + y.k - n) AS strength FROM p JOIN k x ON x.f = file_a JOIN k y ON y.f = file_b)"
)


@query(
    f"WITH {_STRENGTH}, q AS (SELECT * FROM t WHERE strength >= 0.03), a AS (SELECT 'pair' AS section, row_number() OVER (ORDER BY strength DESC, file_a, file_b) AS place, file_a, file_b, strength AS value FROM q), "
    "f AS (SELECT f, sum(n) AS n FROM (SELECT file_a AS f, n FROM q UNION ALL SELECT file_b, n FROM q) GROUP BY f), b AS (SELECT 'file' AS section, row_number() OVER (ORDER BY n DESC, f) AS place, f AS file_a, NULL AS file_b, n::DOUBLE AS value FROM f) "
    f"SELECT section, CAST(place AS INT) AS place, file_a, file_b, {FX.format('value')} AS value FROM (SELECT * FROM a WHERE place <= 20 UNION ALL SELECT * FROM b WHERE place <= 15)"
)
def ag5_cochange_summary(spark, sf_dir):
    """From commits to the report: pairs with a strength of 0.03 or more, the strongest of them and the busiest files."""
    pairs, _ = flows.cochange_analysis(A.commits(_t(spark, sf_dir, "lineitem")), threshold=0.03)
    return flows.cochange_summary(pairs).withColumn("value", fixed(F.col("value")))


@query(
    f"WITH {A.STRINGS}, f AS (SELECT value, count(DISTINCT file) AS files, count(*) AS r, count(DISTINCT call_site) AS c FROM s GROUP BY value), m AS (SELECT max(r) AS most FROM f), t AS (SELECT count(DISTINCT file) AS total FROM s) "
    f"SELECT value, files, r AS \"references\", c AS call_sites, {FX.format('least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * r / most + least(0.2::DOUBLE, 0.05::DOUBLE * c) + least(0.1::DOUBLE, 0.1::DOUBLE * r / greatest(1, total)))')} AS score FROM f, m, t"
)
def ag26_string_topology(spark, sf_dir):
    """All strings, those of one file too."""
    return flows.string_topology(A.page_strings(_t(spark, sf_dir, "pages")), include_single_use=True).withColumn("score", fixed(F.col("score")))


@query(
    f"WITH {A.PART_EDGES}, x AS (SELECT a.p_brand AS src, b.p_brand AS dst, CASE WHEN a.p_size > 25 THEN 'big' ELSE 'small' END AS type FROM e JOIN part a ON e.src = a.p_partkey JOIN part b ON e.dst = b.p_partkey WHERE a.p_brand <> b.p_brand) "
    "SELECT src, dst, count(*) AS n, count(*) FILTER (type = 'big') AS big, count(*) FILTER (type = 'small') AS small FROM x GROUP BY 1, 2"
)
def ag10_level_edges(spark, sf_dir):
    """Edges between brands with a count of each type."""
    n, e = _part_graph(spark, sf_dir)
    size = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"), F.when(F.col("p_size") > 25, "big").otherwise("small").alias("type"))
    out = flows.level_edges(e.join(size, "src"), n, "file")
    return out.select("src", "dst", "n", *[F.coalesce(F.try_element_at("types", F.lit(t)), F.lit(0)).cast("long").alias(t) for t in ("big", "small")])


@query(
    f"WITH {A.PART_EDGES}, c AS (SELECT [a.src, a.dst] AS cycle, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst), "
    "u AS (SELECT cycle, length, unnest(cycle) AS id FROM c), f AS (SELECT cycle, length, list_sort(list(DISTINCT p_brand)) AS files FROM u JOIN part ON p_partkey = id GROUP BY cycle, length HAVING count(DISTINCT p_brand) > 1) "
    "SELECT CAST(row_number() OVER (ORDER BY length, cycle) AS INT) AS place, length, cycle, files, count(*) OVER () AS total FROM f ORDER BY place LIMIT 20"
)
def gr12_cycle_report(spark, sf_dir):
    """The first of all cross-file cycles of up to three parts."""
    n, e = _part_graph(spark, sf_dir)
    return flows.cycle_report(e, n.select("id", "file"))


@query(
    "WITH o AS (SELECT p_brand AS file, p_name AS name, p_type AS type, p_partkey AS id FROM part), r AS (SELECT file, name, id, row_number() OVER (PARTITION BY file, name ORDER BY CASE type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 ELSE 2 END, id) AS k FROM o WHERE type IN ('STANDARD', 'PROMO', 'SMALL')), "
    "n AS (SELECT p_brand AS file, p_name AS name FROM part) SELECT n.file, n.name, coalesce(CAST(r.id AS VARCHAR), n.name) AS target, r.id IS NOT NULL AS resolved FROM n LEFT JOIN r ON n.file = r.file AND n.name = r.name AND k = 1"
)
def j3_resolve_objects(spark, sf_dir):
    """Names of parts as references to the objects of their brand, standard ones before promoted and small ones."""
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_partkey").alias("id"))
    # ids as text of one width, so that their order is that of the numbers
    known = flows.resolved_objects(p.select("file", "name"), p.withColumn("id", F.lpad(F.col("id").cast("string"), 12, "0")), ["STANDARD", "PROMO", "SMALL"])
    return known.withColumn("target", F.when(F.col("resolved"), F.col("target").cast("long").cast("string")).otherwise(F.col("target")))


@query(
    "WITH b AS (SELECT source AS file, doc_id, substr(sha256(text), 1, 16) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS hash, count(*) AS copies FROM b WHERE h IN (SELECT h FROM b WHERE file = 'src1') GROUP BY h HAVING count(*) > 1"
)
def j15_duplicates_of_file(spark, sf_dir):
    """Documents that copy one of a source's documents, by their own hash."""
    d = _t(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("source").alias("file"), F.col("doc_id").alias("id"), C.short_hash(F.col("text")).alias("hash"))
    near = d.join(d.where("file = 'src1'").select("hash").distinct(), "hash", "left_semi")
    return near.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1")


@query("SELECT 'edge' AS kind, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) UNION ALL SELECT 'node', count(*) FROM part")
def sk10_json_graph(spark, sf_dir):
    """A graph written as JSON lines and read again."""
    n, _ = _part_graph(spark, sf_dir)
    e = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    path = fresh_path(spark, "json")
    flows.json_lines(n.select("id", "type", "file", "name"), e).write.partitionBy("kind").text(path)
    nodes, edges = flows.from_json_lines(spark.read.text(path).select("kind", "value"), "long")
    return nodes.where("id IS NOT NULL").agg(F.lit("node").alias("kind"), F.count("*").alias("n")).unionByName(edges.where("type = 'unknown' AND NOT resolved").agg(F.lit("edge").alias("kind"), F.count("*").alias("n")))


@query("WITH a AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS i FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1), b AS (SELECT o_custkey AS key, list_sort(list(DISTINCT o_orderpriority)) AS i FROM orders WHERE o_orderdate < DATE '1995-01-01' GROUP BY 1) "
    "SELECT key, list_sort(list_filter(coalesce(a.i, []), lambda x: NOT list_contains(coalesce(b.i, []), x))) AS added, list_sort(list_filter(coalesce(b.i, []), lambda x: NOT list_contains(coalesce(a.i, []), x))) AS removed FROM a FULL JOIN b USING (key)"
)
def so7_list_changes(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    half = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("o_orderpriority").alias("items"))
    return snapshots.set_changes(half("o_orderdate >= DATE '1995-01-01'"), half("o_orderdate < DATE '1995-01-01'"), "key")
