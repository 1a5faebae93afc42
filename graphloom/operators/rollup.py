"""Roll-ups of graphs: modules, packages, layers, and what nobody uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.build import TEST_FILES

#: Most layer patterns.
LAYER_PATTERNS = 10_000


def _tagged(edges: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Edges with the group of each end as ``a`` and ``b``."""
    e = edges.join(groups.select(F.col("id").alias("src"), F.col(key).alias("a")), "src", how)
    return e.join(groups.select(F.col("id").alias("dst"), F.col(key).alias("b")), "dst", how)


def metagraph(edges: DataFrame, groups: DataFrame, key: str = "module") -> DataFrame:
    """(module, nodes, internal, afferent, efferent, cohesion, instability) of each group; cohesion is 1 without edges, instability 0 without outer ones."""
    e = _tagged(edges, groups, key)
    sides = e.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("g"), F.lit("i").alias("k")))).otherwise(F.array(F.struct(F.col("a").alias("g"), F.lit("o").alias("k")), F.struct(F.col("b").alias("g"), F.lit("n").alias("k"))))).alias("x"))
    n = sides.groupBy(F.col("x.g").alias(key)).agg(F.count_if(F.col("x.k") == "i").alias("internal"), F.count_if(F.col("x.k") == "n").alias("afferent"), F.count_if(F.col("x.k") == "o").alias("efferent"))
    sizes = groups.groupBy(key).agg(F.count("*").alias("nodes"))
    out = sizes.join(n, key, "left").fillna(0, ["internal", "afferent", "efferent"])
    outer = F.col("afferent") + F.col("efferent")
    cohesion = F.when(F.col("internal") + outer == 0, 1.0).otherwise(F.col("internal") / (F.col("internal") + outer))
    return out.withColumn("cohesion", cohesion).withColumn("instability", F.when(outer == 0, 0.0).otherwise(F.col("efferent") / outer))


def inter_edges(edges: DataFrame, groups: DataFrame, key: str = "module", keep_own: bool = False) -> DataFrame:
    """(src, dst, n): edges between groups; nodes without a group stand for themselves if ids and groups have one type."""
    e = _tagged(edges, groups, key)
    return (e if keep_own else e.where("a <> b")).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n"))


def package_of(path: Column) -> Column:
    """The folder of a path with a slash; / for a file at the root, unknown without a path."""
    p = F.regexp_replace(path, r"\\", "/")
    return F.when(F.coalesce(p, F.lit("")) == "", "unknown").when(~p.contains("/"), "/").otherwise(F.regexp_extract(p, "^(.*/)[^/]*$", 1))


def hierarchy(nodes: DataFrame, level: str, shown: int = 10) -> DataFrame:
    """(id, child_count, children): the nodes of one level (a column) with how many and the first of their children."""
    return _first_ids(nodes.select(F.coalesce(F.col(level).cast("string"), F.lit("unknown")).alias("g"), "id"), shown).toDF("id", "child_count", "children")


def _first_ids(rows: DataFrame, shown: int) -> DataFrame:
    """(g, count, first ids) of rows (g, id). Ids are ranked within each group before any are put together, so no list grows with a group."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.col("id").asc_nulls_last()))
    first = rows.withColumn("p", place).where((F.col("p") <= shown) & F.col("id").isNotNull()).groupBy("g").agg(F.array_sort(F.collect_list("id")).alias("first"))
    return sizes.join(first, "g", "left").select("g", "n", F.coalesce("first", F.array().cast(f"array<{rows.schema['id'].dataType.simpleString()}>")))


def layers(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(id, layer): the first layer with a pattern (layer_idx, pattern) that equals the id or that the file starts with, a trailing slash aside. Patterns are a caller's list: more than LAYER_PATTERNS are refused, as all of them meet every node."""
    if patterns.limit(LAYER_PATTERNS + 1).count() > LAYER_PATTERNS:
        raise ValueError(f"more than {LAYER_PATTERNS} layer patterns")
    p = F.broadcast(patterns)
    hit = (F.col("id").cast("string") == F.col("pattern")) | F.col("file").startswith(F.rtrim(F.col("pattern"), F.lit("/")))
    return nodes.join(p, hit).groupBy("id").agg(F.min("layer_idx").alias("layer"))


def layer_edges(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges between nodes that have a layer, with both layers and whether the edge goes the wrong way."""
    return _tagged(edges, placed, "layer").select("src", "dst", F.col("a").alias("src_layer"), F.col("b").alias("dst_layer"), (F.col("a") > F.col("b")).alias("violation"))


def layer_report(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(total, violations, compliance, status) of the edges between layers."""
    n = layer_edges(edges, placed).agg(F.count("*").alias("total"), F.count_if("violation").alias("violations"))
    share = F.when(F.col("total") == 0, 1.0).otherwise((F.col("total") - F.col("violations")) / F.col("total"))
    return n.withColumn("compliance", share).withColumn("status", F.when(F.col("violations") == 0, "clean").when(share >= 0.9, "warning").otherwise("error"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "class"), include_tests: bool = False, edge_types: tuple[str, ...] | None = None) -> DataFrame:
    """Nodes of some kinds with a file that no edge (of some types) goes to; dunder names and entry points don't count."""
    used = edges if edge_types is None else edges.where(F.col("type").isin(*edge_types))
    n = nodes.where(F.col("type").isin(*kinds) & (F.coalesce(F.col("file"), F.lit("")) != "") & ~F.col("name").isin("main", "cli", "app", "run", "start") & ~F.col("name").rlike("^__.*__$"))
    if not include_tests:
        n = n.where(~F.col("file").rlike(TEST_FILES) & ~F.col("name").rlike("^test"))
    return n.join(used.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def orphan_files(nodes: DataFrame, edges: DataFrame, shown: int = 5) -> DataFrame:
    """(file, nodes, first): files that nothing in another file refers to; tests and package markers aside."""
    n = nodes.where((F.coalesce(F.col("file"), F.lit("")) != "") & ~F.col("file").rlike(TEST_FILES) & ~F.col("file").endswith("__init__.py"))
    e = _tagged(edges.select("src", "dst"), nodes, "file").where("a <> b AND a <> ''").select(F.col("b").alias("file")).distinct()
    return _first_ids(n.join(e, "file", "left_anti").select(F.col("file").alias("g"), "id"), shown).toDF("file", "nodes", "first")


def clusters_in_files(edges: DataFrame, nodes: DataFrame, components: DataFrame, least: int = 2) -> DataFrame:
    """(component, file, size, first_line, last_line, internal, cohesion) of components (id, component) of calls within files."""
    n = components.join(nodes.select("id", "file", "line"), "id")
    inside = _tagged(edges.where("src <> dst").select("src", "dst").distinct(), components, "component").where("a = b").groupBy(F.col("a").alias("component")).agg(F.count("*").alias("internal"))
    sizes = n.groupBy("component", "file").agg(F.count("*").alias("size"), F.min("line").alias("first_line"), F.max("line").alias("last_line")).where(F.col("size") >= least)
    out = sizes.join(inside, "component", "left").fillna(0, ["internal"])
    return out.withColumn("cohesion", F.least(F.lit(1.0), F.col("internal") / (F.col("size") * (F.col("size") - 1))))
