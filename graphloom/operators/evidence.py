"""Structural fingerprints, exact duplicates and string topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import spread, written

#: Files of one set of hashes from which on its list is sent to every executor; so many files for each list that is sent.
CROWD = 10_000


def descriptor_hash(a: Column, b: Column, kind: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of two sorted node types and the edge type."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b), kind), 256), 1, 16)


def fingerprints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(hash, file, id): two rows for every edge within a file; edges with a missing end have none. ``edges`` has src, dst, type."""
    n = nodes.select("id", "type", "file")
    e = edges.select("src", "dst", F.col("type").alias("kind")).join(n.select(F.col("id").alias("src"), F.col("type").alias("ta"), F.col("file").alias("fa")), "src")
    e = e.join(n.select(F.col("id").alias("dst"), F.col("type").alias("tb"), F.col("file").alias("fb")), "dst").where("fa = fb AND fa <> ''")
    return e.select(descriptor_hash(F.col("ta"), F.col("tb"), F.col("kind")).alias("hash"), F.col("fa").alias("file"), F.explode(F.array("src", "dst")).alias("id"))


def structurally_similar(index: DataFrame, files: DataFrame, k: int | None = None) -> DataFrame:
    """(scope, file, id, overlap): places outside each scope file (``file``) that share its hashes, with how many index rows match; the k best of each scope."""
    own = index.join(files.select("file"), "file", "left_semi").select(F.col("file").alias("scope"), "hash").distinct()
    out = index.join(own, "hash").where("file <> scope").groupBy("scope", "file", "id").agg(F.count("*").alias("overlap"))
    if k is None:
        return out
    place = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("overlap"), "file", "id"))
    return out.withColumn("p", place).where(F.col("p") <= k).drop("p")


def structurally_similar_each(index: DataFrame, k: int) -> DataFrame:
    """The rows of ``structurally_similar`` with every file of the index as a scope.

    Places that have equal hashes equally often (a kind) overlap equally with any scope, and scopes of equal sets of hashes with any place, so only sets and kinds are compared. Of one file no more than k places are of use to a scope,
    and a scope's own are skipped: 2k places of a kind, and of a set's list, are enough. Shuffled are the index and what sets and kinds have in common.
    """
    n = index.count()
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = spread(index.where("file IS NOT NULL AND hash IS NOT NULL"), "file", rows=n).groupBy("file", "id", "hash").agg(F.count("*").alias("n"))
    places = written(rows.groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("hash", "n"))).alias("kind")), "places")
    few = spread(places, "file", rows=n).withColumn("o", rank(["file", "kind"], "id")).where(F.col("o") <= k)
    first = written(few.withColumn("p", rank(["kind"], "file", "id")).where(F.col("p") <= 2 * k).select("kind", "file", "id"), "first")
    # sure: places of a kind that a scope gets at least, whichever file it is
    sure = first.groupBy("kind", "file").agg(F.count("*").alias("b")).groupBy("kind").agg((F.sum("b") - F.max("b")).alias("sure"))
    kinds = written(sure.withColumn("kind_id", F.monotonically_increasing_id()), "kinds")
    hashes = spread(places, "file", rows=n).select("file", F.explode("kind.hash").alias("hash")).groupBy("file").agg(F.array_sort(F.collect_set("hash")).alias("hashes"))
    scopes = written(hashes.withColumnRenamed("file", "scope"), "scopes")
    sets = written(scopes.groupBy("hashes").agg(F.count("*").alias("many")).withColumn("set_id", F.monotonically_increasing_id()), "sets")
    has = kinds.select("kind_id", "sure", F.explode("kind").alias("x")).select("kind_id", "sure", "x.hash", "x.n")
    found = sets.select("set_id", F.explode("hashes").alias("hash")).join(has, "hash").groupBy("set_id", "kind_id", "sure").agg(F.sum("n").alias("overlap"))
    better = F.sum("sure").over(Window.partitionBy("set_id").orderBy(F.desc("overlap")).rangeBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("better", better).where(F.coalesce("better", F.lit(0)) < k).select("set_id", "kind_id", "overlap")
    best = found.join(first.join(kinds.select("kind", "kind_id"), "kind"), "kind_id").select("set_id", "file", "id", "overlap")
    best = best.withColumn("o", rank(["set_id", "file"], F.desc("overlap"), "id")).where(F.col("o") <= k)
    best = best.withColumn("p", rank(["set_id"], F.desc("overlap"), "file", "id")).where(F.col("p") <= 2 * k)
    lists = best.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("p", "file", "id", "overlap"))).alias("list"))
    lists = written(sets.join(lists, "set_id").select("hashes", "many", "list"), "lists")
    crowds = lists.where(F.col("many") >= CROWD)
    alone = scopes.join(F.broadcast(crowds.select("hashes")), "hashes", "left_anti").join(lists.where(F.col("many") < CROWD), "hashes")
    got = scopes.join(F.broadcast(crowds), "hashes").unionByName(alone)
    return got.select("scope", F.explode(F.slice(F.filter("list", lambda x: x["file"] != F.col("scope")), 1, k)).alias("x")).select("scope", "x.file", "x.id", "x.overlap")


def normalized_code(text: Column) -> Column:
    """Code without block comments, blank lines, line comments (on lines without quotes) and extra blanks."""
    lines = F.split(F.regexp_replace(text, r"(?s)/\*.*?\*/", ""), "\n")
    bare = F.transform(lines, lambda x: F.when(x.contains('"') | x.contains("'"), x).otherwise(F.regexp_replace(x, r"(#|//).*$", "")))
    return F.array_join(F.filter(F.transform(bare, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def exact_duplicates(blocks: DataFrame, least: int = 2) -> DataFrame:
    """(hash, copies, ids): blocks (id, text) of equal text."""
    return blocks.where("text IS NOT NULL").groupBy(content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("id")).alias("ids")).where(F.col("copies") >= least)


def string_files(strings: DataFrame, least: int = 2) -> DataFrame:
    """(value, files, references, call_sites): values (value, file, call_site) that occur in at least ``least`` files."""
    return strings.groupBy("value").agg(F.countDistinct("file").alias("files"), F.count("*").alias("references"), F.countDistinct("call_site").alias("call_sites")).where(F.col("files") >= least)


def importance(found: DataFrame, total_files: DataFrame) -> DataFrame:
    """``found`` with a score of at most 1: half, half of the share of the greatest reference count, and bonuses for call sites and references per file.

    ``total_files`` has one row (total_files): files with any string.
    """
    most = found.agg(F.max("references").alias("most"))
    r = F.col("references")
    score = 0.5 + 0.5 * r / F.col("most") + F.least(F.lit(0.2), 0.05 * F.col("call_sites")) + F.least(F.lit(0.1), 0.1 * r / F.greatest(F.lit(1), F.col("total_files")))
    return found.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(total_files)).withColumn("score", F.least(F.lit(1.0), score)).drop("most", "total_files")


def string_usages(strings: DataFrame, target: str) -> DataFrame:
    """(file, uses) of one value."""
    return strings.where(F.col("value") == target).groupBy("file").agg(F.count("*").alias("uses"))


def grouped_strings(strings: DataFrame) -> DataFrame:
    """(value, file, contexts)."""
    return strings.groupBy("value", "file").agg(F.array_sort(F.collect_list("call_site")).alias("contexts"))


#: Words that say nothing in any language, and in code of one.
NOISE = ", . : ; - _ / \\ true false null none yes no on off utf-8 utf8 ascii".split()
NOISE_OF = {
    "python": "latin-1 r w rb wb a ab".split(),
    "typescript": "undefined div span button input form label a p h1 h2 h3".split(),
    "sql": "plpgsql sql c internal".split(),
    "rust": "r cstr format".split(),
    "bash": "echo test exit".split(),
}


def is_noise(value: Column, least: int = 2, language: str | None = None) -> Column:
    """Values that say nothing: shorter than ``least``, blank, or after lower-casing one of NOISE or of a language's own (of any language without one); in TypeScript also up to three letters."""
    words = sorted({*NOISE, *(NOISE_OF[language] if language else [w for ws in NOISE_OF.values() for w in ws])})
    out = (F.length(value) < least) | value.rlike(r"^\s*$") | F.lower(value).isin(*words)
    if language == "typescript":
        out = out | value.rlike(r"^\p{L}{0,3}$")
    return F.coalesce(out, F.lit(True))


def is_import_path(value: Column) -> Column:
    return value.rlike(r"^(\.\.?/|@[A-Za-z0-9-]+/)")


def is_css_class(value: Column) -> Column:
    """More than half of the words look like utility classes."""
    words = F.filter(F.split(value, r"\s+"), lambda w: w != "")
    css = F.filter(words, lambda w: w.rlike(r"^(flex|grid|hidden|block|relative|absolute)$|^-?(p|m|w|h|px|py|mx|my|pt|pb|mt|mb|text|bg|border|rounded|shadow|gap|items|justify)-"))
    return (F.size(words) > 0) & (F.size(css) * 2 > F.size(words))


def filter_reasons(found: DataFrame, least: int = 3, percentile: int = 95) -> DataFrame:
    """``found`` (value, references, ...) with the first reason to hide it: short, type, import, css, outlier, or null."""
    # how often each count occurs, and how many are as small: the least count that the place falls into; no task holds all values
    tally = found.groupBy("references").agg(F.count("*").alias("n"))
    below = F.sum("n").over(Window.orderBy("references").rowsBetween(Window.unboundedPreceding, 0))
    total = found.agg(F.count("*").alias("all"))
    place = F.least(F.floor(F.col("all") * percentile / 100), F.col("all") - 1)
    limit = tally.withColumn("below", below).crossJoin(F.broadcast(total)).where(F.col("below") > place).agg(F.coalesce(F.min("references"), F.lit(0)).alias("limit"))
    types = "string number boolean object array function undefined any void".split()
    v = F.col("value")
    reason = F.when(F.length(v) < least, "short").when(F.lower(v).isin(*types), "type").when(is_import_path(v), "import").when(is_css_class(v), "css").when(F.col("references") > F.col("limit"), "outlier")
    return found.crossJoin(F.broadcast(limit)).withColumn("reason", reason).drop("limit")
