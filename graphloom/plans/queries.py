"""Registered queries of the engine's own operators over whole tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import build, cochange, components, evidence, rank, reports, rollup, snapshots, traverse, vectors
from graphloom.session import fixed, written
from graphloom.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, *names: str):
    got = tuple(A.table(spark, sf_dir, n) for n in names)
    return got if len(got) > 1 else got[0]


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return A.part_nodes(_t(spark, sf_dir, "part")), A.part_edges(_t(spark, sf_dir, "lineitem"))


def _seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the largest retail price: the place where a change starts."""
    return _t(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select(F.col("p_partkey").alias("id"))


SEED = "seed AS (SELECT p_partkey AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)"
FX = "floor(({}) * 1000000 + 0.5) / 1000000"


def _bfs(depth: int, up: bool = False, both: bool = False) -> str:
    """CTEs r0 ... rN: what a search finds at each depth, and ``r``, all of it."""
    step = "SELECT dst AS a, src AS b FROM e" if up else "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e" if both else "SELECT src AS a, dst AS b FROM e"
    out = f"step AS ({step}), r0 AS (SELECT id AS seed, id, 0 AS depth FROM seed)"
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, id FROM r{k}" for k in range(d))
        out += f", r{d} AS (SELECT seed, id, {d} AS depth FROM (SELECT DISTINCT r.seed, s.b AS id FROM r{d - 1} r JOIN step s ON r.id = s.a) x WHERE NOT EXISTS (SELECT 1 FROM ({seen}) y WHERE y.seed = x.seed AND y.id = x.id))"
    return out + ", r AS (" + " UNION ALL ".join(f"SELECT * FROM r{d}" for d in range(1, depth + 1)) + ")"


# -- graphs: build, filter, summaries


@query(
    "WITH x AS (SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS type, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_suppkey DESC, l_linenumber DESC, l_returnflag DESC) AS k FROM lineitem), "
    "n AS (SELECT p_partkey AS id, p_brand AS type FROM part UNION ALL SELECT s_suppkey, 'supplier' FROM supplier), "
    "y AS (SELECT id, type, row_number() OVER (PARTITION BY id ORDER BY type DESC) AS k FROM n) "
    "SELECT 'edge' AS what, src AS a, dst AS b, type FROM x WHERE k = 1 UNION ALL SELECT 'node', id, NULL, type FROM y WHERE k = 1 "
    "UNION ALL SELECT 'node', id, NULL, NULL FROM (SELECT src AS id FROM x UNION SELECT dst FROM x) WHERE id NOT IN (SELECT id FROM n)"
)
def gr23_build_graph(spark, sf_dir):
    """Nodes and edges: of nodes of one id and of edges between the same ends the last one stays."""
    li, p, sup = _t(spark, sf_dir, "lineitem", "part", "supplier")
    e = li.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("type"), F.struct("l_shipdate", "l_suppkey", "l_linenumber", "l_returnflag").alias("ord"))
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type")).unionByName(sup.select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("type")))
    nodes, e = build.build_graph(nodes.withColumn("ord", F.col("type")), e)
    return e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionByName(nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "type"))


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id, p_type AS type FROM part) SELECT 'node' AS what, coalesce(type, '*') AS kind, count(*) AS n FROM n GROUP BY ROLLUP (type) UNION ALL SELECT 'edge', k, (SELECT count(*) FROM e) FROM (VALUES ('*'), ('unknown')) v(k)")
def ag1_graph_metadata(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    return build.metadata(n.select("id", F.col("package").alias("type")), e)


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id, p_brand AS file FROM part) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(DISTINCT file) FROM n) AS files, count(*) AS edges, count(id) AS resolved, count(DISTINCT CASE WHEN id IS NULL THEN dst END) AS external_targets FROM e LEFT JOIN n ON e.dst = n.id")
def ag2_graph_summary(spark, sf_dir):
    return build.summary(*_part_graph(spark, sf_dir))


@query(f"WITH {A.PART_EDGES} SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY id ORDER BY out_degree DESC, id LIMIT 10")
def w2_degree_top(spark, sf_dir):
    return build.top_n(build.degrees(_part_graph(spark, sf_dir)[1]), "out_degree", 10)


@query("SELECT p_partkey AS id, p_brand AS file, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 5")
def w3_first_per_group(spark, sf_dir):
    p = _t(spark, sf_dir, "part").withColumn("o", -F.col("p_retailprice"))
    return build.first_per_group(p, "p_brand", ["o", "p_partkey"], 5).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("file"), "place")


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id FROM part WHERE starts_with(p_brand, 'Brand#1')) SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def fp1_scope_filter(spark, sf_dir):
    return build.scope_filter(*_part_graph(spark, sf_dir), ["Brand#1"])[1]


@query(f"WITH {A.NATION_EDGES}, n AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey IS NOT NULL) SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def fp6_ranking_filter(spark, sf_dir):
    return build.ranking_filter(A.nation_nodes(_t(spark, sf_dir, "nation")), written(A.nation_edges(spark, sf_dir), "nation-edges"))[1]


_TRADE = "t AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@query(
    f"WITH {A.PART_EDGES}, {_TRADE}, n AS (SELECT p_partkey AS id, p_brand AS name FROM part UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)) "
    "SELECT 'node' AS what, id AS a, NULL AS b, name FROM n UNION ALL SELECT 'edge', src, dst, NULL FROM (SELECT src, dst FROM e UNION SELECT src, dst FROM t)"
)
def ag40_merge_graphs(spark, sf_dir):
    """The part graph and the graph of suppliers and parts: the first graph's nodes win, an edge of both comes once."""
    p, s, li = _t(spark, sf_dir, "part", "supplier", "lineitem")
    trade = li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    n, e = build.merge_graphs([(p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), A.part_edges(li)), (s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), trade)])
    none = F.lit(None)
    return n.select(F.lit("node").alias("what"), F.col("id").alias("a"), none.cast("long").alias("b"), "name").unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), none.cast("string").alias("name")))


@query(
    "WITH c AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_orderstatus = 'P'), n AS (SELECT o_orderkey AS id, o_custkey AS file, o_orderstatus AS name, lead(o_orderkey) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS next FROM orders), "
    "k AS (SELECT * FROM n WHERE file NOT IN (SELECT file FROM c)), a AS (SELECT id, file, name FROM k UNION ALL SELECT -id - 1, file, 'new' FROM n WHERE file IN (SELECT file FROM c)), "
    "f AS (SELECT id AS src, next AS dst FROM n WHERE id IN (SELECT id FROM k) AND next IN (SELECT id FROM k) UNION SELECT -id - 1, next FROM n WHERE -id - 1 IN (SELECT id FROM a) AND next IN (SELECT id FROM a)) "
    "SELECT 'node' AS what, id AS a, file AS b, name FROM a UNION ALL SELECT 'edge', src, dst, NULL FROM f"
)
def sk3_incremental_update(spark, sf_dir):
    """Orders of changed customers get new nodes, with an edge to the next order of the day; the other nodes and the edges between them stay."""
    o = _t(spark, sf_dir, "orders")
    n = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.col("o_orderstatus").alias("name"))
    e = o.select(F.col("o_orderkey").alias("src"), F.lead("o_orderkey").over(Window.partitionBy("o_orderdate").orderBy("o_orderkey")).alias("dst")).where("dst IS NOT NULL")
    changed = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("file")).distinct()
    new = n.select((-F.col("id") - 1).alias("id"), "file", F.lit("new").alias("name"))
    n, e = build.incremental_update(n, e, changed, new, e.select((-F.col("src") - 1).alias("src"), "dst"))
    out = n.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("file").alias("b"), "name")
    return out.unionByName(e.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(None).cast("string").alias("name")))


# -- traversal


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(3)} SELECT depth, count(*) AS n FROM r GROUP BY depth")
def gr7_descendants(spark, sf_dir):
    return traverse.descendants(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir), 3).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(3, up=True)} SELECT id, depth FROM r")
def gr6_ancestors(spark, sf_dir):
    return traverse.ancestors(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir), 3).select("id", "depth")


@query(f"WITH {A.EVENT_EDGES}, seed AS (SELECT DISTINCT src AS id FROM e), {_bfs(2)} SELECT seed, id, depth FROM r")
def gr8_batch_descendants(spark, sf_dir):
    e = A.event_edges(_t(spark, sf_dir, "events"))
    return traverse.descendants(e, e.select(F.col("src").alias("id")).distinct(), 2).select("seed", "id", "depth")


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(1, both=True)}, k AS (SELECT id FROM r UNION SELECT id FROM seed) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def gr17_subgraph(spark, sf_dir):
    return traverse.subgraph(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir), 1)


_NATION_SEEDS = "seed AS (SELECT DISTINCT src AS id FROM e)"


@query(f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS file FROM nation), {_NATION_SEEDS}, {_bfs(3)}, u AS (SELECT 'downstream' AS direction, * FROM r) SELECT u.direction, u.seed, u.id, u.depth, a.file FROM u JOIN nf a ON u.id = a.id JOIN nf b ON u.seed = b.id WHERE a.file <> b.file")
def gr20_impact_downstream(spark, sf_dir):
    e = written(A.nation_edges(spark, sf_dir), "nation-edges")
    return traverse.impact(A.nation_nodes(_t(spark, sf_dir, "nation")), e, e.select(F.col("src").alias("id")), search=traverse.reached_each).where("direction = 'downstream'")


@query(f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS file FROM nation), {_NATION_SEEDS}, {_bfs(3, up=True)} SELECT u.seed, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect FROM r u JOIN nf a ON u.id = a.id JOIN nf b ON u.seed = b.id WHERE a.file <> b.file GROUP BY u.seed")
def ag22_risk(spark, sf_dir):
    e = written(A.nation_edges(spark, sf_dir), "nation-edges")
    up = traverse.impact(A.nation_nodes(_t(spark, sf_dir, "nation")), e, e.select(F.col("src").alias("id")), search=traverse.reached_each).where("direction = 'upstream'")
    return traverse.risk(up).select("seed", "direct", "indirect")


@query(f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS file FROM nation), {_NATION_SEEDS}, {_bfs(3, up=True)} SELECT seed AS symbol, coalesce(list_sort(list(DISTINCT file) FILTER (depth = 1)), []) AS direct_files, coalesce(list_sort(list(DISTINCT file) FILTER (depth > 1)), []) AS indirect_files FROM r JOIN nf USING (id) GROUP BY seed")
def ag21_breaking_changes(spark, sf_dir):
    e = written(A.nation_edges(spark, sf_dir), "nation-edges")
    return traverse.breaking_changes(A.nation_nodes(_t(spark, sf_dir, "nation")), e, e.select(F.col("src").alias("id")), search=traverse.reached_each)


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id, p_brand AS file FROM part) SELECT dst AS symbol, count(DISTINCT a.file) AS used_by, list_sort(list(DISTINCT a.file)) AS files FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id WHERE a.file <> b.file GROUP BY dst")
def ag20_symbol_usage(spark, sf_dir):
    return traverse.symbol_usage(*_part_graph(spark, sf_dir))


@query(
    f"WITH RECURSIVE {A.NATION_EDGES}, ends AS (SELECT min(src) AS s, max(dst) AS t FROM e), p AS (SELECT s AS id, [s] AS path FROM ends UNION ALL SELECT e.dst, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.id WHERE len(p.path) < 4 AND NOT list_contains(p.path, e.dst)) SELECT path, CAST(len(path) - 1 AS INT) AS length FROM p, ends WHERE p.id = t ORDER BY len(path), path LIMIT 1"
)
def gr13_shortest_path(spark, sf_dir):
    e = written(A.nation_edges(spark, sf_dir), "nation-edges")
    s, t = e.agg(F.min("src"), F.max("dst")).first()
    return traverse.shortest_path(e, s, t)


# -- rankings and components


def _pagerank_sql(rounds: int) -> str:
    out = f"{A.PART_EDGES}, k AS (SELECT src, count(*) AS k FROM e GROUP BY src), l AS (SELECT e.src, e.dst, k.k FROM e JOIN k USING (src)), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM ids), p0 AS (SELECT id, 1.0::DOUBLE / n AS rank FROM ids, n)"
    for r in range(1, rounds + 1):
        out += f", g{r} AS MATERIALIZED (SELECT l.dst AS id, sum(p.rank / l.k) AS got FROM p{r - 1} p JOIN l ON l.src = p.id GROUP BY l.dst), d{r} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) / max(n) AS lost FROM p{r - 1}, n WHERE id NOT IN (SELECT src FROM k)), p{r} AS MATERIALIZED (SELECT ids.id, (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * (coalesce(got, 0) + coalesce(lost, 0)) AS rank FROM ids CROSS JOIN n CROSS JOIN d{r} LEFT JOIN g{r} ON g{r}.id = ids.id)"
    return f"WITH {out} SELECT id, floor(rank * 1e9 + 0.5) / 1e9 AS rank FROM p{rounds}"


@query(_pagerank_sql(10))
def gr1_pagerank(spark, sf_dir):
    return rank.pagerank(_part_graph(spark, sf_dir)[1], rounds=10).select("id", fixed(F.col("rank"), 9).alias("rank"))


def _betweenness_sql() -> str:
    """Distances and path counts of all pairs of the nation graph, whose diameter is small."""
    out = f"{A.NATION_EDGES}, ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), q0 AS (SELECT id AS s, id AS t, 0 AS d, 1.0::DOUBLE AS c FROM ids)"
    for k in range(1, 6):
        seen = " UNION ALL ".join(f"SELECT s, t FROM q{j}" for j in range(k))
        out += f", q{k} AS MATERIALIZED (SELECT q.s, e.dst AS t, {k} AS d, sum(q.c) AS c FROM q{k - 1} q JOIN e ON e.src = q.t WHERE (q.s, e.dst) NOT IN (SELECT (s, t) FROM ({seen})) GROUP BY q.s, e.dst)"
    allq = " UNION ALL ".join(f"SELECT * FROM q{j}" for j in range(6))
    return f"WITH {out}, q AS MATERIALIZED ({allq}), b AS (SELECT x.t AS id, sum(x.c * y.c / z.c) AS score FROM q x JOIN q y ON x.t = y.s JOIN q z ON z.s = x.s AND z.t = y.t WHERE x.s <> x.t AND y.s <> y.t AND z.d = x.d + y.d AND x.s <> y.t GROUP BY x.t) SELECT ids.id, {FX.format('coalesce(score, 0) / ((n - 1) * (n - 2))')} AS score FROM ids LEFT JOIN b USING (id), (SELECT count(*) AS n FROM ids)"


@query(_betweenness_sql())
def gr3_betweenness(spark, sf_dir):
    return rank.betweenness(written(A.nation_edges(spark, sf_dir), "nation-edges")).select("id", fixed(F.col("score")).alias("score"))


@query()
def gr5_sampled_betweenness(spark, sf_dir):
    return rank.betweenness(_part_graph(spark, sf_dir)[1], sample=100)


@query(f"WITH RECURSIVE {A.EVENT_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e), c AS (SELECT src AS id, dst AS root FROM b UNION SELECT c.id, b.dst FROM c JOIN b ON c.root = b.src) SELECT id, min(root) AS component FROM c GROUP BY id")
def gr9_connected_components(spark, sf_dir):
    return components.connected_components(A.event_edges(_t(spark, sf_dir, "events")).select("src", "dst"))


@query(f"WITH RECURSIVE {A.NATION_EDGES}, c AS (SELECT src AS a, dst AS b FROM e UNION SELECT c.a, e.dst FROM c JOIN e ON c.b = e.src), m AS (SELECT x.a AS id, x.b AS o FROM c x JOIN c y ON x.a = y.b AND x.b = y.a) SELECT id, min(o) AS component FROM m GROUP BY id HAVING count(DISTINCT o) > 1")
def gr10_strong_components(spark, sf_dir):
    return components.strongly_connected(written(A.nation_edges(spark, sf_dir), "nation-edges"))


@query(f"WITH {A.PART_EDGES}, c AS (SELECT [a.src, a.dst] AS cycle, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst) SELECT length, count(*) AS n FROM c GROUP BY length")
def gr11_cycles(spark, sf_dir):
    return components.simple_cycles(_part_graph(spark, sf_dir)[1], 3).groupBy("length").agg(F.count("*").alias("n"))


@query(f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, n_regionkey AS f FROM nation) SELECT [a.src, a.dst] AS cycle, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src JOIN nf x ON x.id = a.src JOIN nf y ON y.id = a.dst WHERE a.src < a.dst AND x.f <> y.f")
def gr12_cross_file_cycles(spark, sf_dir):
    return components.simple_cycles(written(A.nation_edges(spark, sf_dir), "nation-edges"), 2, A.nation_nodes(_t(spark, sf_dir, "nation")))


@query(f"WITH {A.PART_EDGES}, nf AS (SELECT p_partkey AS id, p_brand AS f FROM part), c AS (SELECT [a.src, a.dst] AS cycle, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst UNION ALL SELECT [a.src, a.dst, b.dst], 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND b.dst <> a.dst), u AS (SELECT cycle, length, unnest(cycle) AS id FROM c) SELECT cycle, length FROM u LEFT JOIN nf USING (id) GROUP BY cycle, length HAVING count(DISTINCT f) > 1")
def gr12_cross_file_cycles_parts(spark, sf_dir):
    """Cross-file cycles of parts up to the operator's default length; gr12_cross_file_cycles has only the two-cycles of nations, as its SQL does."""
    n, e = _part_graph(spark, sf_dir)
    return components.simple_cycles(e, files=n)


@query()
def gr15_communities(spark, sf_dir):
    return components.communities(_part_graph(spark, sf_dir)[1])


# -- whole part graph: the queries above of the same names have the nation graph, or fewer rounds or steps, as their SQL does


def _each(spark, sf_dir):
    """Nodes and edges of the part graph, and every part with an edge as a seed."""
    n, e = _part_graph(spark, sf_dir)
    e = written(e, "part-edges")
    return n, e, e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


@query(f"WITH {A.PART_EDGES}, n AS (SELECT p_partkey AS id FROM part WHERE coalesce(p_brand, '') <> '') SELECT src, dst FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def fp6_ranking_filter_parts(spark, sf_dir):
    return build.ranking_filter(*_part_graph(spark, sf_dir))[1]


@query()
def gr1_pagerank_parts(spark, sf_dir):
    """All 100 rounds of the operator."""
    return rank.pagerank(_part_graph(spark, sf_dir)[1]).select("id", fixed(F.col("rank"), 9).alias("rank"))


@query()
def gr3_betweenness_parts(spark, sf_dir):
    """Exact, from every part."""
    return rank.betweenness(_part_graph(spark, sf_dir)[1]).select("id", fixed(F.col("score")).alias("score"))


@query()
def gr10_strong_components_parts(spark, sf_dir):
    return components.strongly_connected(_part_graph(spark, sf_dir)[1])


@query()
def gr13_shortest_path_parts(spark, sf_dir):
    e = _part_graph(spark, sf_dir)[1]
    s, t = e.agg(F.min("src"), F.max("dst")).first()
    return traverse.shortest_path(e, s, t)


@query()
def gr16_community_report_parts(spark, sf_dir):
    """Representatives by all 100 rounds of PageRank."""
    n, e = _part_graph(spark, sf_dir)
    return reports.community_report(n, e, components.communities(e), rank.pagerank(e))


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(2, both=True)}, k AS (SELECT id FROM r UNION SELECT id FROM seed) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def gr17_subgraph_parts(spark, sf_dir):
    return traverse.subgraph(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir))


@query()
def gr20_impact_parts(spark, sf_dir):
    """Both directions, of every part whose id is divisible by 20, in the whole graph."""
    n, e, seeds = _each(spark, sf_dir)
    return traverse.impact_each(n, e, seeds.where("id % 20 = 0"))


@query()
def ag21_breaking_changes_parts(spark, sf_dir):
    return traverse.breaking_changes_each(*_each(spark, sf_dir))


@query()
def ag22_risk_parts(spark, sf_dir):
    return traverse.risk_each(*_each(spark, sf_dir))


@query()
def ag23_group_by_file_parts(spark, sf_dir):
    """What a change of each part reaches downstream, file by file."""
    return traverse.group_by_file_each(*_each(spark, sf_dir))


# -- roll-ups


def _meta_sql(edges: str, groups: str) -> str:
    return f"""WITH {edges}, g AS ({groups}), x AS (SELECT a.module AS a, b.module AS b FROM e JOIN g a ON e.src = a.id JOIN g b ON e.dst = b.id),
s AS (SELECT module, count(*) AS nodes FROM g GROUP BY module), c AS (SELECT s.module, nodes, (SELECT count(*) FROM x WHERE a = s.module AND b = s.module) AS internal, (SELECT count(*) FROM x WHERE b = s.module AND a <> b) AS afferent, (SELECT count(*) FROM x WHERE a = s.module AND a <> b) AS efferent FROM s)
SELECT module, nodes, internal, afferent, efferent, {FX.format('CASE WHEN internal + afferent + efferent = 0 THEN 1.0::DOUBLE ELSE internal::DOUBLE / (internal + afferent + efferent) END')} AS cohesion, {FX.format('CASE WHEN afferent + efferent = 0 THEN 0.0::DOUBLE ELSE efferent::DOUBLE / (afferent + efferent) END')} AS instability FROM c"""


@query(_meta_sql(A.PART_EDGES, "SELECT p_partkey AS id, p_brand AS module FROM part"))
def ag9_metagraph(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    m = rollup.metagraph(e, n.select("id", F.col("file").alias("module")))
    return m.withColumn("cohesion", fixed(F.col("cohesion"))).withColumn("instability", fixed(F.col("instability")))


@query(f"WITH {A.PART_EDGES}, g AS (SELECT p_partkey AS id, p_type AS module FROM part) SELECT a.module AS src, b.module AS dst, count(*) AS n FROM e JOIN g a ON e.src = a.id JOIN g b ON e.dst = b.id WHERE a.module <> b.module GROUP BY 1, 2")
def ag10_hierarchy_edges(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    return rollup.inter_edges(e, n, "package")


@query("SELECT p_type AS id, count(*) AS child_count, list_sort(list(p_partkey))[1:10] AS children FROM part GROUP BY p_type")
def ag10_hierarchy_nodes(spark, sf_dir):
    return rollup.hierarchy(_part_graph(spark, sf_dir)[0], "package")


_LAYERS = [(i, f"Brand#{i + 1}/") for i in range(5)]
_LAYER_SQL = "p AS (SELECT p_partkey AS id, CAST(substr(p_brand, 7, 1) AS INT) - 1 AS layer FROM part WHERE substr(p_brand, 7, 1) BETWEEN '1' AND '5'), v AS (SELECT a.layer AS la, b.layer AS lb FROM e JOIN p a ON e.src = a.id JOIN p b ON e.dst = b.id)"


@query(f"WITH {A.PART_EDGES}, {_LAYER_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (la > lb) AS violations FROM v) SELECT total, violations, {FX.format('CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE (total - violations)::DOUBLE / total END')} AS compliance, CASE WHEN violations = 0 THEN 'clean' WHEN (total - violations)::DOUBLE / total >= 0.9 THEN 'warning' ELSE 'error' END AS status FROM c")
def ag14_layer_report(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    placed = rollup.layers(n, spark.createDataFrame(_LAYERS, "layer_idx int, pattern string"))
    return rollup.layer_report(e, placed).withColumn("compliance", fixed(F.col("compliance")))


@query(f"WITH {A.PART_EDGES}, {_LAYER_SQL} SELECT la AS src_layer, lb AS dst_layer, count(*) AS n FROM v WHERE la > lb GROUP BY 1, 2")
def ag13_layer_violations(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    placed = rollup.layers(n, spark.createDataFrame(_LAYERS, "layer_idx int, pattern string"))
    return rollup.layer_edges(e, placed).where("violation").groupBy("src_layer", "dst_layer").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def ag15_dead_code(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    n = c.select(F.col("c_custkey").alias("id"), F.lit("function").alias("type"), F.col("c_mktsegment").alias("file"), F.col("c_name").alias("name"))
    e = o.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.col("o_orderstatus").alias("type"))
    return rollup.dead_code(n, e, edge_types=("P",)).select("id")


@query(f"WITH {A.EVENT_EDGES}, {A.EVENT_NODES} SELECT file, count(*) AS nodes, list_sort(list(id))[1:5] AS first FROM n WHERE file NOT IN (SELECT b.file FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id WHERE a.file <> b.file) GROUP BY file")
def ag16_orphan_files(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return rollup.orphan_files(A.event_nodes(ev), A.event_edges(ev))


@query(
    f"WITH RECURSIVE {A.EVENT_EDGES}, {A.EVENT_NODES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e), c AS (SELECT src AS id, dst AS root FROM b UNION SELECT c.id, b.dst FROM c JOIN b ON c.root = b.src), k AS (SELECT id, min(root) AS component FROM c GROUP BY id), s AS (SELECT component, file, count(*) AS size, min(line) AS first_line, max(line) AS last_line FROM k JOIN n USING (id) GROUP BY ALL HAVING count(*) >= 2), i AS (SELECT a.component, count(*) AS internal FROM (SELECT DISTINCT src, dst FROM e WHERE src <> dst) e JOIN k a ON e.src = a.id JOIN k b ON e.dst = b.id WHERE a.component = b.component GROUP BY 1) SELECT s.component, file, size, first_line, last_line, coalesce(internal, 0) AS internal, {FX.format('least(1.0::DOUBLE, coalesce(internal, 0)::DOUBLE / (size * (size - 1)))')} AS cohesion FROM s LEFT JOIN i USING (component)"
)
def ag32_function_clusters(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    e, n = A.event_edges(ev), A.event_nodes(ev)
    return rollup.clusters_in_files(e, n, components.connected_components(e.select("src", "dst"))).withColumn("cohesion", fixed(F.col("cohesion")))


# -- co-change


_PAIRS = "s AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem), p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS n FROM s a JOIN s b ON a.c = b.c AND a.f < b.f GROUP BY 1, 2 HAVING count(*) >= 2), k AS (SELECT l_partkey AS f, count(*) AS listed FROM lineitem GROUP BY 1), st AS (SELECT file_a, file_b, n, n::DOUBLE / (a.listed + b.listed - n) AS strength FROM p JOIN k a ON a.f = file_a JOIN k b ON b.f = file_b)"


@query(f"WITH {_PAIRS} SELECT file_a, file_b, n FROM p")
def ag3_cochange_pairs(spark, sf_dir):
    return cochange.pair_counts(A.commits(_t(spark, sf_dir, "lineitem")))


@query(f"WITH {_PAIRS} SELECT file_a, file_b, n, {FX.format('strength')} AS strength FROM st WHERE strength >= 0.03")
def ag4_cochange_strength(spark, sf_dir):
    return cochange.strength(A.commits(_t(spark, sf_dir, "lineitem")), threshold=0.03).withColumn("strength", fixed(F.col("strength")))


@query(f"WITH {_PAIRS}, t AS (SELECT * FROM st WHERE strength >= 0.03), f AS (SELECT file_a AS f FROM t UNION SELECT file_b FROM t) SELECT count(*) AS pairs, {FX.format('coalesce(avg(strength), 0)')} AS mean_strength, {FX.format('coalesce(max(strength), 0)')} AS max_strength, (SELECT count(*) FROM f) AS files FROM t")
def ag6_cochange_metadata(spark, sf_dir):
    m = cochange.metadata(cochange.strength(A.commits(_t(spark, sf_dir, "lineitem")), threshold=0.03))
    return m.withColumn("mean_strength", fixed(F.col("mean_strength"))).withColumn("max_strength", fixed(F.col("max_strength")))


@query(f"WITH {_PAIRS} SELECT f AS file, CAST(sum(n) AS BIGINT) AS total FROM (SELECT file_a AS f, n FROM p UNION ALL SELECT file_b, n FROM p) GROUP BY f ORDER BY total DESC, file LIMIT 15")
def ag7_busiest_files(spark, sf_dir):
    return cochange.busiest(cochange.pair_counts(A.commits(_t(spark, sf_dir, "lineitem"))))


@query(f"WITH {_PAIRS}, {SEED} SELECT f AS file, o AS other, {FX.format('strength')} AS strength FROM (SELECT file_a AS f, file_b AS o, strength FROM st UNION ALL SELECT file_b, file_a, strength FROM st) WHERE f IN (SELECT id FROM seed)")
def ag8_cochange_neighbours(spark, sf_dir):
    pairs = cochange.strength(A.commits(_t(spark, sf_dir, "lineitem")), threshold=0.0)
    return cochange.neighbours(pairs, _seed(spark, sf_dir).select(F.col("id").alias("file"))).withColumn("strength", fixed(F.col("strength")))


# -- fingerprints, duplicates, strings


_INDEX = f"{A.EVENT_EDGES}, {A.EVENT_NODES}, x AS (SELECT substr(sha256(concat_ws('|', least(a.type, b.type), greatest(a.type, b.type), 'next')), 1, 16) AS hash, a.file, unnest([e.src, e.dst]) AS id FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id WHERE a.file = b.file)"


def _index(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    return evidence.fingerprints(A.event_nodes(ev), A.event_edges(ev).withColumn("type", F.lit("next")))


@query(f"WITH {_INDEX} SELECT hash, count(*) AS rows, count(DISTINCT file) AS files FROM x GROUP BY hash")
def ag17_fingerprints(spark, sf_dir):
    return _index(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("rows"), F.countDistinct("file").alias("files"))


@query(f"WITH {_INDEX}, s AS (SELECT min(file) AS file FROM x) SELECT s.file AS scope, x.file, x.id, count(*) AS overlap FROM x, s WHERE x.file <> s.file AND hash IN (SELECT hash FROM x JOIN s USING (file)) GROUP BY ALL ORDER BY overlap DESC, x.file, x.id LIMIT 15")
def ag18_structural_similarity(spark, sf_dir):
    ix = _index(spark, sf_dir)
    return evidence.structurally_similar(ix, ix.agg(F.min("file").alias("file")), 15)


@query("SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS copies, list_sort(list(doc_id)) AS ids FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def ag19_exact_duplicates(spark, sf_dir):
    return evidence.exact_duplicates(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_FOUND = f"{A.STRINGS}, f AS (SELECT value, count(DISTINCT file) AS files, count(*) AS \"references\", count(DISTINCT call_site) AS call_sites FROM s GROUP BY value HAVING count(DISTINCT file) >= 2)"


@query(f"WITH {_FOUND} SELECT * FROM f")
def ag24_significant_strings(spark, sf_dir):
    return evidence.string_files(A.page_strings(_t(spark, sf_dir, "pages")))


@query(f"WITH {_FOUND}, m AS (SELECT max(\"references\") AS most FROM f), t AS (SELECT count(DISTINCT file) AS total FROM s) SELECT value, {FX.format('least(1.0::DOUBLE, 0.5::DOUBLE + 0.5::DOUBLE * \"references\" / most + least(0.2::DOUBLE, 0.05::DOUBLE * call_sites) + least(0.1::DOUBLE, 0.1::DOUBLE * \"references\" / greatest(1, total)))')} AS score FROM f, m, t")
def ag25_string_importance(spark, sf_dir):
    s = A.page_strings(_t(spark, sf_dir, "pages"))
    return evidence.importance(evidence.string_files(s), s.agg(F.countDistinct("file").alias("total_files"))).select("value", fixed(F.col("score")).alias("score"))


@query(f"WITH {A.STRINGS}, m AS (SELECT value FROM s GROUP BY value ORDER BY count(*) DESC, value LIMIT 1) SELECT file, count(*) AS uses FROM s WHERE value IN (SELECT value FROM m) GROUP BY file")
def ag27_string_usages(spark, sf_dir):
    s = A.page_strings(_t(spark, sf_dir, "pages"))
    top = s.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").first()
    return evidence.string_usages(s, top["value"] if top else "")


@query(f"WITH {A.STRINGS} SELECT value, file, list_sort(list(call_site)) AS contexts FROM s GROUP BY value, file")
def ag28_grouped_strings(spark, sf_dir):
    return evidence.grouped_strings(A.page_strings(_t(spark, sf_dir, "pages")))


@query(
    f"WITH {_FOUND}, c AS (SELECT list_sort(list(\"references\")) AS c FROM f) SELECT coalesce(CASE WHEN length(value) < 3 THEN 'short' WHEN lower(value) IN ('string','number','boolean','object','array','function','undefined','any','void') THEN 'type' WHEN regexp_matches(value, '^(\\.\\.?/|@[A-Za-z0-9-]+/)') THEN 'import' WHEN \"references\" > c[least(CAST(floor(len(c) * 95 / 100) AS INT), len(c) - 1) + 1] THEN 'outlier' END, 'kept') AS reason, count(*) AS n FROM f, c GROUP BY 1"
)
def fp12_string_filter(spark, sf_dir):
    found = evidence.string_files(A.page_strings(_t(spark, sf_dir, "pages")))
    return evidence.filter_reasons(found).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


# -- vectors


def _vectors(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


_D = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query(f"SELECT q.vec_id AS query, v.vec_id AS id, floor(greatest(0, least(1, {_D.format('v.embedding', 'q.embedding')})) * 1e4 + 0.5) / 1e4 AS similarity FROM embeddings v, (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE v.vec_id <> q.vec_id ORDER BY similarity DESC LIMIT 10")
def vs1_similar_code(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.orderBy("id").limit(1).select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    return vectors.search(v, q, 10, 0.0).select("query", "id", fixed(F.col("similarity"), 4).alias("similarity"))


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, floor({_D.format('a.embedding', 'b.embedding')} * 1e4 + 0.5) / 1e4 AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE {_D.format('a.embedding', 'b.embedding')} >= 0.4")
def vs7_near_pairs(spark, sf_dir):
    return vectors.near_pairs(_vectors(spark, sf_dir), 0.4, "label").withColumn("similarity", fixed(F.col("similarity"), 4))


@query("SELECT vec_id AS id, floor(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * 1e4 + 0.5) / 1e4 AS squared FROM embeddings")
def vs10_squared_norm(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", fixed(vectors.dot(F.col("vector"), F.col("vector")), 4).alias("squared"))


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(2)}, q AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT v.vec_id AS id, greatest(0, least(1, {_D.format('v.embedding', 'q.embedding')})) AS sim FROM embeddings v, q WHERE v.vec_id <> q.vec_id) SELECT r.id, r.depth, floor((0.6::DOUBLE * sim + 0.4::DOUBLE / (r.depth + 1)) * 1e4 + 0.5) / 1e4 AS score FROM r JOIN s USING (id)")
def vs5_fused_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.orderBy("id").limit(1).select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    sim = v.crossJoin(F.broadcast(q)).where("id <> query").select("id", vectors.clipped(vectors.cosine(F.col("vector"), F.col("qv"))).alias("similarity"))
    r = traverse.descendants(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir), 2)
    return r.join(sim, "id").select("id", "depth", fixed(vectors.fused_score(F.col("similarity"), F.col("depth")), 4).alias("score"))


# -- snapshots and scalar functions


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate >= DATE '1995-01-01' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderdate < DATE '1995-01-01' GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def ag43_snapshot_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    half = lambda c: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    return snapshots.diff(half("o_orderdate >= DATE '1995-01-01'"), half("o_orderdate < DATE '1995-01-01'"), "k", "v").select("k", "change")


@query("WITH n AS (SELECT doc_id AS id, sha256(text) AS h FROM documents), o AS (SELECT doc_id AS id, sha256(CASE WHEN lang = 'en' THEN text || '.' ELSE text END) AS h FROM documents WHERE lang <> 'fr') SELECT CASE WHEN o.h IS NULL THEN 'new' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS n FROM n LEFT JOIN o USING (id) GROUP BY 1")
def ag41_incremental_refresh(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    new = d.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    old = d.where("lang <> 'fr'").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("lang") == "en", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("content_hash"))
    return vectors.refresh(new, old).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, 'src/' || p_type || '/' || p_brand || '.py' AS path, 'src/' || p_type || '/' AS package, p_brand || '.py::' || p_mfgr AS short, 'python' AS language FROM (SELECT *, 'm' AS p_mfgr FROM (SELECT p_partkey, p_type, p_brand FROM part))")
def f1_names(spark, sf_dir):
    path = F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_brand", F.lit(".py"))
    node = F.concat(F.lit("py:"), path, F.lit("::m"))
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.file_of(node).alias("path"), rollup.package_of(path).alias("package"), T.short_name(node).alias("short"), T.language_of(path).alias("language"))


@query("SELECT doc_id AS id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def f18_estimated_tokens(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.estimated_tokens(F.col("text")).alias("tokens"))


@query("SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def so3_difference(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    of = lambda status: o.where(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("key"))
    return of("F").subtract(of("O"))


@query("SELECT DISTINCT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def so4_intersection(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("key")).intersect(s.select(F.col("s_nationkey").alias("key")))


@query(
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT list_sort(list(n)) AS l FROM c) SELECT user_id AS id, n FROM c, s WHERE n > l[least(CAST(floor(len(l) * 95 / 100) AS INT), len(l) - 1) + 1]"
)
def w7_percentile_outliers(spark, sf_dir):
    n = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("value")).agg(F.count("*").alias("references"))
    marked = evidence.filter_reasons(n.withColumn("id", F.col("value")).withColumn("value", F.lit("some value")))
    return marked.where("reason = 'outlier'").select("id", F.col("references").alias("n"))


@query("SELECT vec_id AS id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS place FROM embeddings")
def w10_ordinals(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", (F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1).alias("place"))


@query(
    "WITH m AS (SELECT min(event_type) AS mark FROM events), x AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = mark THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, mark FROM events, m) SELECT user_id AS id, CAST(run AS BIGINT) AS run, count(*) AS n FROM x WHERE event_type <> mark GROUP BY 1, 2"
)
def w11_runs_between_marks(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    ev = ev.crossJoin(F.broadcast(ev.agg(F.min("event_type").alias("mark"))))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = ev.withColumn("run", F.sum((F.col("event_type") == F.col("mark")).cast("int")).over(w))
    return x.where("event_type <> mark").groupBy(F.col("user_id").alias("id"), "run").agg(F.count("*").alias("n"))


@query(
    "WITH last AS (SELECT n_regionkey || '' AS name, max_by(n_nationkey, n_nationkey) AS id FROM nation GROUP BY 1) SELECT c_custkey AS src, coalesce(CAST(last.id AS VARCHAR), CAST(c_nationkey AS VARCHAR)) AS dst, last.id IS NOT NULL AS resolved FROM customer LEFT JOIN last ON CAST(c_nationkey AS VARCHAR) = last.name"
)
def j2_resolve_names(spark, sf_dir):
    c, n = _t(spark, sf_dir, "customer", "nation")
    nodes = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_regionkey").cast("string").alias("name"), F.col("n_nationkey").alias("ord"))
    e = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("string").alias("dst"), F.lit(False).alias("resolved"))
    return build.resolve_names(e, nodes)


@query(f"WITH {A.STRINGS}, v AS (SELECT DISTINCT value FROM s) SELECT length(value) < 2 OR regexp_full_match(value, '\\s*') OR lower(value) IN (', . : ; - _ /') OR list_contains(string_split(', . : ; - _ / \\ true false null none yes no on off utf-8 utf8 ascii latin-1 r w rb wb a ab undefined div span button input form label p h1 h2 h3 plpgsql sql c internal cstr format echo test exit', ' '), lower(value)) AS noise, count(*) AS n FROM v GROUP BY 1")
def fp11_noise(spark, sf_dir):
    v = A.page_strings(_t(spark, sf_dir, "pages")).select("value").distinct()
    return v.groupBy(evidence.is_noise(F.col("value")).alias("noise")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT lang AS language, count(*) AS files FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT language, files, language = (SELECT language FROM n ORDER BY files DESC, language LIMIT 1) AS primary FROM n")
def ag29_language_histogram(spark, sf_dir):
    return reports.language_histogram(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("lang").alias("language")))


@query(
    f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, n_regionkey AS f FROM nation), a AS (SELECT count(*) AS dead_code FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')), b AS (SELECT count(*) AS duplicates FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)), c AS (SELECT count(*) AS cycles FROM e x JOIN e y ON x.dst = y.src AND y.dst = x.src JOIN nf p ON p.id = x.src JOIN nf q ON q.id = x.dst WHERE x.src < x.dst AND p.f <> q.f), h AS (SELECT dead_code, duplicates, cycles, CAST(0 AS BIGINT) AS stale_docs, dead_code + 2 * duplicates + 3 * cycles AS score FROM a, b, c) SELECT *, CASE WHEN score = 0 THEN 'excellent' WHEN score < 5 THEN 'good' WHEN score < 15 THEN 'fair' ELSE 'needs_attention' END AS status FROM h"
)
def ag35_health(spark, sf_dir):
    return reports.health(dead_code=ag15_dead_code(spark, sf_dir), duplicates=ag19_exact_duplicates(spark, sf_dir), cycles=gr12_cross_file_cycles(spark, sf_dir))


@query()
def ag35_health_parts(spark, sf_dir):
    """The health score on all cycles of gr12_cross_file_cycles_parts."""
    return reports.health(dead_code=ag15_dead_code(spark, sf_dir), duplicates=ag19_exact_duplicates(spark, sf_dir), cycles=gr12_cross_file_cycles_parts(spark, sf_dir))


@query(f"WITH {A.NATION_EDGES}, nf AS (SELECT n_nationkey AS id, CAST(n_regionkey AS VARCHAR) AS file FROM nation), {_NATION_SEEDS}, {_bfs(2)} SELECT file, list_sort(list(DISTINCT id)) AS ids FROM r JOIN nf USING (id) GROUP BY file")
def ag23_group_by_file(spark, sf_dir):
    e, n = A.nation_edges(spark, sf_dir), A.nation_nodes(_t(spark, sf_dir, "nation"))
    found = traverse.descendants(e, e.select(F.col("src").alias("id")), 2).join(n.select("id", "file"), "id")
    return traverse.group_by_file(found)


@query(f"WITH {A.PART_EDGES}, {SEED}, {_bfs(1, both=True)}, q AS (SELECT * FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT v.vec_id AS id, greatest(0, least(1, {_D.format('v.embedding', 'q.embedding')})) AS sim FROM embeddings v, q WHERE v.vec_id <> q.vec_id) SELECT id, floor(sim * 1e4 + 0.5) / 1e4 AS similarity FROM s WHERE sim >= 0.2 AND id NOT IN (SELECT id FROM r) ORDER BY sim DESC, id LIMIT 5")
def vs4_related_unconnected(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    q = v.orderBy("id").limit(1).select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    sim = v.crossJoin(F.broadcast(q)).where("id <> query").select("id", vectors.clipped(vectors.cosine(F.col("vector"), F.col("qv"))).alias("similarity"))
    r = traverse.reached(_part_graph(spark, sf_dir)[1], _seed(spark, sf_dir), 1, "both")
    return vectors.related_unconnected(sim, r, 0.2).select("id", fixed(F.col("similarity"), 4).alias("similarity"))


@query()
def gr16_community_report(spark, sf_dir):
    n, e = _part_graph(spark, sf_dir)
    return reports.community_report(n, e, components.communities(e), rank.pagerank(e, rounds=10))


# -- every row as a query: the queries of the same names without ``_all`` have one row or file, as their SQL does


@query()
def vs1_similar_code_all(spark, sf_dir):
    return vectors.nearest(_vectors(spark, sf_dir), 10, 0.0).select("query", "id", fixed(F.col("similarity"), 4).alias("similarity"))


@query()
def vs4_related_unconnected_all(spark, sf_dir):
    """For every vector, the 5 most similar that no edge joins to the part of the same id."""
    v, e = _vectors(spark, sf_dir), _part_graph(spark, sf_dir)[1]
    joined = e.select(F.col("src").alias("query"), F.col("dst").alias("id")).unionByName(e.select(F.col("dst").alias("query"), F.col("src").alias("id"))).distinct()
    joined = written(joined.join(v.select("id"), "id", "left_semi").join(v.select(F.col("id").alias("query")), "query", "left_semi").select("query", "id"), "joined")
    # at most so many of the best are taken away again
    most = joined.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    left = vectors.nearest(v, 5 + most, 0.2).join(joined, ["query", "id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return left.withColumn("p", place).where("p <= 5").select("query", "id", fixed(F.col("similarity"), 4).alias("similarity"))


@query()
def vs5_fused_scores_all(spark, sf_dir):
    """For every vector, all within two steps of the part of the same id that have a vector."""
    v = _vectors(spark, sf_dir)
    found = traverse.fused_each(_part_graph(spark, sf_dir)[1], v, 2)
    return found.withColumn("score", fixed(F.col("score"), 4))


@query()
def ag18_structural_similarity_all(spark, sf_dir):
    ix = written(_index(spark, sf_dir), "index")
    return evidence.structurally_similar_each(ix, 15)


@query(f"WITH {_PAIRS} SELECT file_a AS file, file_b AS other, {FX.format('strength')} AS strength FROM st UNION ALL SELECT file_b, file_a, {FX.format('strength')} FROM st")
def ag8_cochange_neighbours_all(spark, sf_dir):
    c = A.commits(_t(spark, sf_dir, "lineitem"))
    return cochange.neighbours(cochange.strength(c, threshold=0.0), c.select("file").distinct()).withColumn("strength", fixed(F.col("strength")))
