"""Making, merging and filtering graphs: nodes (id, ...) and edges (src, dst, ...) as plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import spread

#: Paths of tests, as a search pattern.
#: Found anywhere in a path.
TEST_FILES = r"test_[^/]+\.py$|[^/]+_test\.py$|tests?/|__tests__/|\.(test|spec)\.[tj]sx?$"


def kept_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row of each key, the first by ``order``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return spread(df, *keys).withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A simple graph of rows with an insertion order ``ord``: the last row of an id or pair wins, edges with an empty end go, ends without a row become bare nodes."""
    n = kept_by(nodes.where("id IS NOT NULL"), ["id"], F.desc("ord")).drop("ord")
    e = kept_by(edges.where("src IS NOT NULL AND dst IS NOT NULL AND CAST(src AS STRING) <> '' AND CAST(dst AS STRING) <> ''"), ["src", "dst"], F.desc("ord")).drop("ord")
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(n.select("id"), "id", "left_anti")
    return n.unionByName(ends, allowMissingColumns=True), e


def merge_graphs(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Union of graphs; the first graph that has a node or pair wins."""
    both = [[g[k].withColumn("__g", F.lit(i)) for i, g in enumerate(graphs)] for k in (0, 1)]
    n, e = (reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), x) for x in both)
    return kept_by(n, ["id"], F.asc("__g")).drop("__g"), kept_by(e, ["src", "dst"], F.asc("__g")).drop("__g")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """The first edge of each (src, dst, type) by ``ord``."""
    return kept_by(edges, ["src", "dst", "type"], F.asc("ord"))


def incremental_update(nodes: DataFrame, edges: DataFrame, changed: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the nodes of changed files (``file``) by new ones; edges of dropped nodes go, new edges come if both their ends are there."""
    stay = nodes.join(changed, "file", "left_anti")
    n = stay.unionByName(new_nodes.join(changed, "file", "left_semi"), allowMissingColumns=True)
    old = both_ends(edges, stay.select("id"))
    return n, old.unionByName(both_ends(new_edges, n.select("id")), allowMissingColumns=True).dropDuplicates(["src", "dst"])


def both_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def scope_filter(nodes: DataFrame, edges: DataFrame, scopes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose file starts with a scope (or equals it without its slash), and the edges among them."""
    tests = [F.col("file").startswith(s) | (F.col("file") == s.rstrip("/")) for s in scopes]
    n = nodes.where((F.coalesce(F.col("file"), F.lit("")) != "") & reduce(lambda a, b: a | b, tests, F.lit(False)))
    return n, both_ends(edges, n.select("id"))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILES)


def is_external(file: Column) -> Column:
    """A node without a file is external."""
    return F.coalesce(file.cast("string"), F.lit("")) == ""


def ranking_filter(nodes: DataFrame, edges: DataFrame, scope: str = "source_only", exclude_external: bool = True) -> tuple[DataFrame, DataFrame]:
    """The graph that rankings look at: without external nodes, and without (or with only) tests."""
    n = nodes.where(~is_external(F.col("file"))) if exclude_external else nodes
    test = F.coalesce(is_test_file(F.col("file")), F.lit(False))
    n = n.where(~test) if scope == "source_only" else n.where(test) if scope == "tests_only" else n
    return n, both_ends(edges, n.select("id"))


def metadata(nodes: DataFrame, edges: DataFrame, kind: str = "type") -> DataFrame:
    """(what, kind, n): counts of nodes and edges in all and by type; a missing type is unknown."""
    out = []
    for what, df in (("node", nodes), ("edge", edges)):
        k = F.coalesce(F.col(kind), F.lit("unknown")) if kind in df.columns else F.lit("unknown")
        tagged = df.select(k.alias("kind"))
        counts = tagged.rollup("kind").agg(F.count("*").alias("n"), F.grouping("kind").alias("all"))
        out.append(counts.select(F.lit(what).alias("what"), F.when(F.col("all") == 1, "*").otherwise(F.col("kind")).alias("kind"), "n"))
    return out[0].unionByName(out[1])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all ends, in one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def top_n(df: DataFrame, score: str, n: int = 10, descending: bool = True, tie: str = "id") -> DataFrame:
    """The n rows of the highest (or lowest) score; ties by id."""
    return df.orderBy(F.col(score).desc() if descending else F.col(score).asc(), tie).limit(n)


def first_per_group(df: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, files, edges, resolved edges, distinct external targets, mean degree."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("file").alias("files"))
    outside = edges.join(nodes.where(~is_external(F.col("file"))).select(F.col("id").alias("dst"), F.lit(True).alias("known")), "dst", "left")
    e = outside.agg(F.count("*").alias("edges"), F.count("known").alias("resolved"), F.countDistinct(F.when(F.col("known").isNull(), F.col("dst"))).alias("external_targets"))
    return n.crossJoin(e)


def resolve_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Unresolved targets by name: an edge whose dst is no id but the name of a node goes to the last node (by ``ord``) of that name."""
    last = nodes.groupBy("name").agg(F.max_by("id", "ord").alias("__id")).withColumnRenamed("name", "__name")
    out = edges.join(last, (F.col("dst") == F.col("__name")) & ~F.col("resolved"), "left")
    return out.withColumn("dst", F.coalesce("__id", "dst")).withColumn("resolved", F.col("resolved") | F.col("__id").isNotNull()).drop("__id", "__name")
