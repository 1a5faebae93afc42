"""The engine's table shapes, made of the relational tables: graphs, commits, string occurrences, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(lineitem: DataFrame) -> DataFrame:
    """(src, dst): parts that follow each other in an order; a simple directed graph without loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    n = lineitem.count()
    rows = spread(lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", rows=n)
    steps = rows.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return spread(steps.where("dst IS NOT NULL AND src <> dst"), "src", "dst", rows=n).distinct()


def part_nodes(part: DataFrame) -> DataFrame:
    """(id, type, file, package, name): a part's brand is its file, its type its package."""
    return part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("type"), F.col("p_brand").alias("file"), F.col("p_type").alias("package"), F.col("p_name").alias("name"))


def event_node() -> Column:
    return F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"))


def event_edges(events: DataFrame) -> DataFrame:
    """(src, dst, file): consecutive kinds of events of one user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    named = events.select("user_id", event_node().alias("src"), F.lead(event_node()).over(w).alias("dst"))
    return named.where("dst IS NOT NULL").select("src", "dst", F.col("user_id").cast("string").alias("file")).distinct()


def event_nodes(events: DataFrame) -> DataFrame:
    """(id, type, file, line): kinds of events of a user, with the place of the first in the user's events."""
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.select(event_node().alias("id"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("file"), at.alias("line"))
    return rows.groupBy("id", "type", "file").agg(F.min("line").alias("line"))


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customer's nation to supplier's nation, where they trade at least as often as an average pair."""
    t = lambda n: table(spark, sf_dir, n)
    trade = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    trade = trade.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src")), "o_custkey")
    trade = trade.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst")), "l_suppkey")
    pairs = trade.groupBy("src", "dst").agg(F.count("*").alias("n"))
    mean = pairs.agg(F.avg("n").alias("mean"))
    return pairs.crossJoin(F.broadcast(mean)).where("n >= mean AND src <> dst").select("src", "dst")


def nation_nodes(nation: DataFrame) -> DataFrame:
    """(id, name, file, module): a nation's region is its file and module."""
    return nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("file"), F.col("n_regionkey").alias("module"))


def commits(lineitem: DataFrame) -> DataFrame:
    """(commit_id, file): the parts of an order; a part that is listed twice stays twice."""
    return lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))


def page_strings(pages: DataFrame) -> DataFrame:
    """(value, file, call_site): link targets of pages; the call site is the host of the page."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(F.explode(links).alias("value"), F.col("page_id").alias("file"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("call_site"))


PART_EDGES = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"
EVENT_EDGES = "e AS (SELECT DISTINCT src, dst, file FROM (SELECT CAST(user_id AS VARCHAR) AS file, user_id || ':' || event_type AS src, lead(user_id || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
EVENT_NODES = "n AS (SELECT id, type, file, min(line) AS line FROM (SELECT user_id || ':' || event_type AS id, event_type AS type, CAST(user_id AS VARCHAR) AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events) GROUP BY ALL)"
NATION_EDGES = "t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), e AS (SELECT src, dst FROM t WHERE n >= (SELECT avg(n) FROM t) AND src <> dst)"
STRINGS = "s AS (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS value, page_id AS file, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS call_site FROM pages)"
