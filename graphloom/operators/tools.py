"""Reports that put operators together, as a tool would show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import build, components, evidence, rank, rollup, snapshots, traverse
from graphloom.session import written

#: Sampled sources of betweenness beyond rank.EXACT_NODES nodes: a tenth of them, within these bounds.
SAMPLES = (100, 500)
STDLIB = (
    "abc aifc argparse array ast asynchat asyncio asyncore atexit audioop base64 bdb binascii binhex bisect builtins bz2 calendar cgi cgitb chunk cmath cmd code codecs codeop collections colorsys compileall concurrent configparser contextlib "
    "contextvars copy copyreg cProfile crypt csv ctypes curses dataclasses datetime dbm decimal difflib dis distutils doctest email encodings enum errno faulthandler fcntl filecmp fileinput fnmatch fractions ftplib functools gc getopt getpass gettext "
    "glob graphlib grp gzip hashlib heapq hmac html http idlelib imaplib imghdr imp importlib inspect io ipaddress itertools json keyword lib2to3 linecache locale logging lzma mailbox mailcap marshal math mimetypes mmap modulefinder multiprocessing netrc "
    "nis nntplib numbers operator optparse os ossaudiodev pathlib pdb pickle pickletools pipes pkgutil platform plistlib poplib posix posixpath pprint profile pstats pty pwd py_compile pyclbr pydoc queue quopri random re readline reprlib resource "
    "rlcompleter runpy sched secrets select selectors shelve shlex shutil signal site smtpd smtplib sndhdr socket socketserver spwd sqlite3 ssl stat statistics string stringprep struct subprocess sunau symtable sys sysconfig syslog tabnanny tarfile "
    "telnetlib tempfile termios test textwrap threading time timeit tkinter token tokenize trace traceback tracemalloc tty turtle turtledemo types typing typing_extensions unicodedata unittest urllib uu uuid venv warnings wave weakref webbrowser winreg "
    "winsound wsgiref xdrlib xml xmlrpc zipapp zipfile zipimport zlib zoneinfo"
).split()
#: Ids of what has no file, which no ranking takes part in.
OUTSIDE = ("[stdlib]", "[external]", "unknown")


def is_stdlib(module: Column) -> Column:
    """Whether the root of a dotted module, after a language mark such as ``py:``, is a standard one."""
    return F.split(F.regexp_replace(module, "^[^:]*:", ""), r"\.")[0].isin(*STDLIB)


def collapsed(nodes: DataFrame, edges: DataFrame, level: str) -> tuple[DataFrame, DataFrame]:
    """(ids, edges) of the graph of one level (a column of the nodes); nodes without a value and edges within one are left out."""
    groups = nodes.select("id", F.col(level).cast("string").alias("g")).where(F.coalesce("g", F.lit("unknown")) != "unknown")
    e = rollup.inter_edges(edges, groups, "g").select("src", "dst")
    return groups.select(F.col("g").alias("id")).distinct(), e


def pagerank_report(nodes: DataFrame, edges: DataFrame, top: int = 20, level: str | None = None, scope: str = "source_only", exclude_external: bool = True, rounds: int = 100) -> DataFrame:
    """(place, id, importance) of the most important nodes, or groups of a level, of the filtered graph."""
    n, e = build.ranking_filter(nodes, edges, scope, exclude_external)
    if level:
        n, e = collapsed(n, e, level)
    return _placed(rank.pagerank(e, nodes=n.select("id"), rounds=rounds).withColumnRenamed("rank", "score"), top, "importance")


def betweenness_report(nodes: DataFrame, edges: DataFrame, top: int = 20, level: str | None = None, scope: str = "source_only", exclude_external: bool = True, sample: int | None = None) -> DataFrame:
    """(place, id, betweenness) of the bottlenecks of the filtered graph: exact, or from ``sample`` sources; without one, sampled beyond rank.EXACT_NODES nodes."""
    n, e = build.ranking_filter(nodes, edges, scope, exclude_external)
    if level:
        n, e = collapsed(n, e, level)
    if sample is None:
        many = n.count()
        sample = min(SAMPLES[1], max(SAMPLES[0], many // 10)) if many > rank.EXACT_NODES else None
    scores = n.select("id").join(rank.betweenness(e, sample=sample), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return _placed(scores, top, "betweenness")


def _placed(scores: DataFrame, top: int, name: str) -> DataFrame:
    best = build.top_n(scores.select("id", F.round("score", 12).alias("score")), "score", top)
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("x"))  # at most ``top`` of them
    return rows.select(F.posexplode("x").alias("place", "x")).select((F.col("place") + 1).alias("place"), F.col("x.id").alias("id"), F.round(-F.col("x.s"), 6).alias(name))


def path_report(nodes: DataFrame, edges: DataFrame, source: object, target: object, shown: int = 5) -> DataFrame:
    """(side, place, id): the nodes of the shortest path, side ``path``; if there is none, the first ids that contain the source (side ``source``) and the target, and why (side ``reason``)."""
    found = traverse.shortest_path(edges, source, target)
    path = found.select(F.lit("path").alias("side"), F.posexplode("path").alias("place", "id")).select("side", (F.col("place") + 1).alias("place"), F.col("id").cast("string").alias("id"))
    if not found.isEmpty():
        return path
    ids = nodes.select(F.col("id").cast("string").alias("id"))
    near = [ids.where(F.contains("id", F.lit(str(x)))).orderBy("id").limit(shown) for x in (source, target)]
    there = [not x.isEmpty() for x in near]
    reason = {(False, False): "neither is a node", (False, True): "the source is no node", (True, False): "the target is no node", (True, True): "no edges lead from the source to the target"}[tuple(there)]
    out = nodes.sparkSession.createDataFrame([("reason", 1, reason)], "side string, place int, id string")
    for side, x in zip(("source", "target"), near):
        rows = x.agg(F.array_sort(F.collect_list("id")).alias("x")).select(F.posexplode("x").alias("place", "id"))
        out = out.unionByName(rows.select(F.lit(side).alias("side"), (F.col("place") + 1).alias("place"), "id"))
    return out


def split_unknown(nodes: DataFrame, level: str, shown: int = 10) -> DataFrame:
    """The hierarchy of a level (id, child_count, children), with nodes of none in [stdlib] or [external] by the root of their id. All of them count, not just those that are shown."""
    group = F.when(F.coalesce(F.col(level).cast("string"), F.lit("unknown")) != "unknown", F.col(level).cast("string")).otherwise(F.when(is_stdlib(F.col("id").cast("string")), "[stdlib]").otherwise("[external]"))
    return rollup.hierarchy(nodes.withColumn(level, group), level, shown)


def hierarchy_report(nodes: DataFrame, edges: DataFrame, level: str, exclude_external: bool = False) -> DataFrame:
    """One row: hierarchy_nodes, hierarchy_edges, original_nodes, compression (nodes of the level for one of the graph), stdlib and external (how many nodes these hold)."""
    h = split_unknown(nodes, level)
    e = rollup.inter_edges(edges, nodes.withColumn(level, F.coalesce(F.col(level).cast("string"), F.lit("unknown"))), level)
    if exclude_external:
        h, e = h.where(~F.col("id").isin(*OUTSIDE)), e.where(~F.col("src").isin(*OUTSIDE) & ~F.col("dst").isin(*OUTSIDE))
    held = lambda x: F.coalesce(F.sum(F.when(F.col("id") == x, F.col("child_count"))), F.lit(0)).cast("long")
    n = h.agg(F.count("*").alias("hierarchy_nodes"), held("[stdlib]").alias("stdlib"), held("[external]").alias("external"))
    out = n.crossJoin(e.agg(F.count("*").alias("hierarchy_edges"))).crossJoin(nodes.agg(F.count("*").alias("original_nodes")))
    return out.select("hierarchy_nodes", "hierarchy_edges", "original_nodes", F.round(F.col("hierarchy_nodes") / F.greatest("original_nodes", F.lit(1)), 4).alias("compression"), "stdlib", "external")


def refactor_report(nodes: DataFrame, edges: DataFrame, blocks: DataFrame, file: str) -> DataFrame:
    """(section, key, items): what a change of a file's code would meet: who uses its symbols, what would break, copies of its blocks (id, file, text), clusters of its functions."""
    own = nodes.where(F.col("file") == file).select("id")
    usage = traverse.symbol_usage(nodes, edges).join(own.withColumnRenamed("id", "symbol"), "symbol", "left_semi")
    breaks = traverse.breaking_changes_each(nodes, edges, own)
    named = blocks.where(F.col("text").isNotNull()).select("file", F.concat_ws(":", "file", "id").alias("place"), evidence.content_hash(F.col("text")).alias("hash"))
    copies = named.join(named.where(F.col("file") == file).select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.array_sort(F.collect_list("place")).alias("items")).where(F.size("items") > 1)
    inside = build.both_ends(edges.select("src", "dst"), own)
    clusters = components.connected_components(inside).groupBy("component").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("items"))
    s = lambda df, name, key, items: df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("key"), F.col(items).alias("items"))
    changed = breaks.select("symbol", F.array_sort(F.array_union("direct_files", "indirect_files")).alias("items"))
    return s(usage, "symbol_usage", "symbol", "files").unionByName(s(changed, "breaking_changes", "symbol", "items")).unionByName(s(copies, "duplicates", "hash", "items")).unionByName(s(clusters, "clusters", "component", "items"))


def confidence_buckets(refs: DataFrame, shown: dict[str, int] | None = None) -> DataFrame:
    """The first stale references (doc_file, line, raw_text, confidence, found) of each confidence: 20 of high, 20 of medium, 10 of low, with ``total`` of each."""
    shown = {"high": 20, "medium": 20, "low": 10} if shown is None else shown
    stale = refs.where("NOT found AND confidence IS NOT NULL")
    total = stale.groupBy("confidence").agg(F.count("*").alias("total"))
    limit = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])[F.col("confidence")]
    first = build.first_per_group(stale, "confidence", ["doc_file", "line", "raw_text"], max(shown.values())).where(F.col("place") <= F.coalesce(limit, F.lit(0)))
    return first.join(total, "confidence").select("confidence", "place", "doc_file", "line", "raw_text", "total")


def strings_report(strings: DataFrame, top: int = 10, sites: int = 5) -> DataFrame:
    """(value, files, references, call_sites) of the most referenced strings in two files or more, with the first call sites of each."""
    found = evidence.string_files(strings)
    best = build.top_n(found.withColumnRenamed("value", "id"), "references", top).select(F.col("id").alias("value"), "files", "references")
    uses = strings.join(F.broadcast(best.select("value")), "value", "left_semi").select("value", "call_site").distinct()
    return best.join(build.first_per_group(uses, "value", ["call_site"], sites).groupBy("value").agg(F.array_sort(F.collect_list("call_site")).alias("call_sites")), "value", "left")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, n): what a snapshot of a graph remembers: nodes, edges and files, nodes of each type and edges of each type."""
    by = lambda df, name: df.groupBy(F.concat(F.lit(name + ":"), F.coalesce("type", F.lit("unknown"))).alias("metric")).agg(F.count("*").alias("n"))
    one = lambda df, name: df.select(F.lit(name).alias("metric"), "n")
    out = one(nodes.agg(F.count("*").alias("n")), "nodes").unionByName(one(nodes.agg(F.countDistinct("file").alias("n")), "files")).unionByName(one(edges.agg(F.count("*").alias("n")), "edges"))
    return out.unionByName(by(nodes, "nodes")).unionByName(by(edges, "edges"))


def changes_since(nodes: DataFrame, edges: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(metric, before, now, delta) of all metrics of ``graph_summary`` that differ from a snapshot's (metric, n)."""
    both = graph_summary(nodes, edges).select("metric", F.col("n").alias("now")).join(snapshot.select("metric", F.col("n").alias("before")), "metric", "full")
    both = both.select("metric", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"))
    return both.withColumn("delta", F.col("now") - F.col("before")).where("delta <> 0")


def stale_rule_paths(rules: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, path): paths in rules (file, text) that are no file or folder of the tree (file), unless the folder holds a name that begins with the path's stem."""
    refs = rules.select(F.col("file").alias("rule"), F.explode(T.code_paths(F.regexp_replace("text", r"(?s)^---\s*\n.*?\n---\s*", ""))).alias("path"))
    return missing_paths(refs, files)


def missing_paths(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``refs`` (path, ...) that are stale; see ``stale_rule_paths``."""
    parts = F.split("file", "/")
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("path")).distinct()
    left = refs.join(every, "path", "left_anti")
    folder = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    left = left.withColumns({"in_folder": folder("path"), "stem": F.split(name("path"), r"\.")[0]})
    names = every.select(folder("path").alias("in_folder"), name("path").alias("sibling"))
    # siblings that begin with a stem: equal beginnings of the stem's length, so the join has equal keys
    lengths = left.select("in_folder", F.length("stem").alias("n")).distinct()
    begins = names.join(lengths, "in_folder").select("in_folder", F.expr("substring(sibling, 1, n)").alias("stem")).distinct()
    return left.join(begins, ["in_folder", "stem"], "left_anti").drop("in_folder", "stem")


def audit(nodes: DataFrame, edges: DataFrame, rules: DataFrame, files: DataFrame, top: int = 20) -> DataFrame:
    """(section, path, detail): files of the most important nodes and of the bottlenecks, whether a rule names them (``covered`` or ``gap``), and stale paths of rules (``stale``)."""
    at = nodes.select("id", "file")
    critical = pagerank_report(nodes, edges, top).join(at, "id").select("file", F.lit("critical").alias("kind"), "place")
    narrow = betweenness_report(nodes, edges, top).join(at, "id").select("file", F.lit("bottleneck").alias("kind"), "place")
    # critical files first, each file once, as ordered unions keep it
    spots = critical.unionByName(narrow).where(F.coalesce("file", F.lit("")) != "").groupBy(F.col("file").alias("path")).agg(F.max("kind").alias("kind"))
    spots = written(spots, "hotspots")
    cover = T.path_coverage(rules, spots.select("path")).join(spots, "path")
    out = cover.select(F.when(F.col("covered"), "covered").otherwise("gap").alias("section"), "path", F.col("kind").alias("detail"))
    return out.unionByName(stale_rule_paths(rules, files).select(F.lit("stale").alias("section"), "path", F.col("rule").alias("detail")))


def audit_summary(found: DataFrame) -> DataFrame:
    """One row of an audit: hotspots, covered, gaps, stale, coverage in per cent."""
    n = found.agg(*[F.count_if(F.col("section") == s).alias(c) for s, c in (("covered", "covered"), ("gap", "gaps"), ("stale", "stale"))])
    spots = F.col("covered") + F.col("gaps")
    return n.select(spots.alias("hotspots"), "covered", "gaps", "stale", F.when(spots > 0, F.round(F.col("covered") * 100 / spots, 1)).otherwise(0.0).alias("coverage"))


def around(nodes: DataFrame, edges: DataFrame, scope: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """The part of a graph near nodes whose id begins with or contains a scope: these nodes, those ``hops`` steps away, and the edges among them. Nothing else is read into memory."""
    seeds = nodes.where(F.contains(F.col("id").cast("string"), F.lit(scope))).select("id")
    e = traverse.subgraph(edges, seeds, hops)
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(seeds).distinct()
    return nodes.join(ids, "id", "left_semi"), e


def smart_graph(nodes: DataFrame, edges: DataFrame, suggested: list[str], ignores: list[str]) -> tuple[DataFrame, DataFrame]:
    """The graph of the folders that a scout suggests, without files that its ignores name."""
    n = nodes.where(~T.ignored(F.coalesce("file", F.lit("")), ignores))
    return build.scope_filter(n, build.both_ends(edges, n.select("id")), suggested) if suggested else (n, build.both_ends(edges, n.select("id")))


__all__ = ["audit", "betweenness_report", "changes_since", "hierarchy_report", "pagerank_report", "path_report", "refactor_report", "snapshots"]
