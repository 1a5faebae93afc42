"""Whole analyses, from rows of a source to their report."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import build, cochange, components, evidence, reports, rollup, tools
from graphloom.session import written

#: Manifests that name dependencies, and the frameworks that these dependencies mean.
FRAMEWORKS = "next nuxt vite gatsby remix astro react vue svelte angular express webpack parcel turbo nx pytest django flask fastapi celery pydantic".split()
MANAGERS = {"package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "bun.lockb": "bun", "poetry.lock": "poetry", "uv.lock": "uv", "pdm.lock": "pdm", "Pipfile.lock": "pipenv", "requirements.txt": "pip", "Cargo.lock": "cargo", "go.sum": "go"}
CI = r"^(\.github/workflows/[^/]+\.ya?ml|\.gitlab-ci\.yml|\.circleci/config\.yml|azure-pipelines\.yml|Jenkinsfile|\.travis\.yml)$"


# -- graphs of several sources


def prefixed(id: Column, source: Column) -> Column:
    """Ids of symbols get the mark of the language they come from; others stay."""
    mark = F.when(source == "python", "py:").when(source == "typescript", "ts:")
    return F.when(id.contains("::") & mark.isNotNull() & ~id.startswith(mark), F.concat(mark, id)).otherwise(id)


def merged(nodes: DataFrame, edges: DataFrame, cochanges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ids, edges) of several graphs: nodes (id, source), edges (src, dst, type, source, ord), with the first edge of each pair and type, and edges between Python and TypeScript files that change together (file_a, file_b, ...)."""
    ids = nodes.select(prefixed(F.col("id"), F.col("source")).alias("id")).distinct()
    e = edges.withColumns({"src": prefixed(F.col("src"), F.col("source")), "dst": prefixed(F.col("dst"), F.col("source"))})
    e = build.kept_by(e, ["src", "dst", "type"], F.asc("ord")).select("src", "dst", "type", "source")
    if cochanges is not None:
        cross = cochange.cross_language(cochanges)
        e = e.unionByName(cross.select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"), F.lit("co-occurs-cross-language").alias("type"), F.lit("merged").alias("source")))
    return ids, e


def graph_kind(name: str, generator: str | None, first_edges: list[dict]) -> str:
    """What made a JSON graph: by its file's name, by what it says of its generator, by the ends of its first edges."""
    for text in (name.rsplit("/", 1)[-1].lower(), (generator or "").lower()):
        for word, kind in (("cooccur", "cooccurrence"), ("co_occur", "cooccurrence"), ("cochange", "cooccurrence"), ("python", "python"), ("typescript", "typescript"), ("_ts", "typescript")):
            if word in text:
                return kind
    for e in first_edges[:10]:
        if "strength" in e or e.get("type") == "co_occurs":
            return "cooccurrence"
        ends = [str(e.get(k, "")).split("::")[0] for k in ("from", "to", "source", "target")]
        if any(x.endswith(".py") for x in ends):
            return "python"
        if any(re.search(r"\.[jt]sx?$", x) for x in ends):
            return "typescript"
    return "unknown"


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): every node and edge as JSON text, with ``unknown``, an empty text and ``false`` where a type, a file or name, or ``resolved`` is missing. Lines, so that a graph of any size is written."""
    some = lambda df, c, kind, other: F.coalesce(F.col(c).cast(kind), F.lit(other)).alias(c) if c in df.columns else F.lit(other).alias(c)
    line = F.col("line").cast("int") if "line" in nodes.columns else F.lit(None).cast("int")
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", some(nodes, "type", "string", "unknown"), some(nodes, "file", "string", ""), some(nodes, "name", "string", ""), line.alias("line"))).alias("value"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), some(edges, "type", "string", "unknown"), some(edges, "resolved", "boolean", False))).alias("value"))
    return n.unionByName(e)


def from_json_lines(rows: DataFrame, kind: str = "string") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``json_lines``; ends may also be called source and target; edges without an end go."""
    n = rows.where("kind = 'node'").select(F.from_json("value", f"id {kind}, type string, file string, name string, line int").alias("x")).select("x.*")
    e = rows.where("kind = 'edge'").select(F.from_json("value", f"`from` {kind}, `to` {kind}, source {kind}, target {kind}, type string, resolved boolean").alias("x"))
    e = e.select(F.coalesce("x.from", "x.source").alias("src"), F.coalesce("x.to", "x.target").alias("dst"), F.coalesce("x.type", F.lit("unknown")).alias("type"), F.coalesce("x.resolved", F.lit(False)).alias("resolved"))
    return n, e.where("src IS NOT NULL AND dst IS NOT NULL AND CAST(src AS STRING) <> '' AND CAST(dst AS STRING) <> ''")


def resolved_objects(names: DataFrame, objects: DataFrame, types: list[str]) -> DataFrame:
    """(file, name, target, resolved): names (file, name) as the object (file, type, name, id) of their file that has the first of the types; unknown names stay themselves."""
    rank = F.create_map(*[F.lit(x) for k, t in enumerate(types) for x in (t, k)])[F.col("type")]
    known = objects.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("file", "name").agg(F.min_by("id", F.struct("rank", "id")).alias("target"))
    return names.join(known, ["file", "name"], "left").select("file", "name", F.coalesce("target", "name").alias("target"), F.col("target").isNotNull().alias("resolved"))


# -- change history


def cochange_analysis(commits: DataFrame, least: int = 2, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(pairs with their strength, one row of metadata) of commits (commit_id, file)."""
    pairs = written(cochange.strength(commits, least, threshold), "pairs")
    return pairs, cochange.metadata(pairs)


def cochange_summary(pairs: DataFrame, top: int = 20, hot: int = 15) -> DataFrame:
    """(section, place, file_a, file_b, value): the strongest pairs (of equals, the first by name) and the files of the most joint changes."""
    best = pairs.select((-F.col("strength")).alias("s"), "file_a", "file_b").orderBy("s", "file_a", "file_b").limit(top)
    best = best.agg(F.array_sort(F.collect_list(F.struct("s", "file_a", "file_b"))).alias("x")).select(F.posexplode("x").alias("at", "x"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("file_a").alias("f"), "n"), F.struct(F.col("file_b").alias("f"), "n"))).alias("e")).groupBy("e.f").agg(F.sum("e.n").alias("n"))
    busy = ends.select((-F.col("n")).alias("s"), "f").orderBy("s", "f").limit(hot)
    busy = busy.agg(F.array_sort(F.collect_list(F.struct("s", "f"))).alias("x")).select(F.posexplode("x").alias("at", "x"))
    none = F.lit(None).cast(pairs.schema["file_a"].dataType)
    a = best.select(F.lit("pair").alias("section"), (F.col("at") + 1).alias("place"), F.col("x.file_a").alias("file_a"), F.col("x.file_b").alias("file_b"), (-F.col("x.s")).alias("value"))
    return a.unionByName(busy.select(F.lit("file").alias("section"), (F.col("at") + 1).alias("place"), F.col("x.f").alias("file_a"), none.alias("file_b"), (-F.col("x.s")).cast("double").alias("value")))


# -- strings, duplicates, cycles, levels


def string_topology(strings: DataFrame, include_single_use: bool = False) -> DataFrame:
    """(value, files, references, call_sites, importance) of the strings in two files or more, or in any."""
    found = evidence.string_files(strings, 1 if include_single_use else 2)
    return evidence.importance(found, strings.agg(F.countDistinct("file").alias("total_files")))


def duplicates_of(blocks: DataFrame, file: str | None = None) -> DataFrame:
    """(hash, copies, places) of equal blocks (file, line_start, line_end, content) after normalisation, the most copied first by ``copies``; with a file, only of its blocks."""
    b = blocks.select("file", F.concat_ws(":", "file", "line_start", "line_end").alias("place"), evidence.content_hash(evidence.normalized_code(F.col("content"))).alias("hash"))
    if file is not None:
        b = b.join(b.where(F.col("file") == file).select("hash").distinct(), "hash", "left_semi")
    return b.groupBy("hash").agg(F.count("*").alias("copies"), F.array_sort(F.collect_list("place")).alias("places")).where("copies > 1").withColumn("hash", F.substring("hash", 1, 8))


def cycle_report(edges: DataFrame, files: DataFrame, shown: int = 20, most: int | None = 3) -> DataFrame:
    """(place, length, cycle, files, total): the first cross-file cycles by length, then by their nodes, with their files and how many cycles there are. ``most``: as in simple_cycles."""
    found = written(components.simple_cycles(edges, most, files), "cycles")
    first = found.orderBy("length", "cycle").limit(shown).agg(F.array_sort(F.collect_list(F.struct("length", "cycle"))).alias("x")).select(F.posexplode("x").alias("at", "x"))
    ends = first.select((F.col("at") + 1).alias("place"), F.col("x.length").alias("length"), F.col("x.cycle").alias("cycle"))
    names = ends.select("place", F.explode("cycle").alias("id")).join(files.select("id", "file"), "id").where(F.coalesce("file", F.lit("")) != "").groupBy("place").agg(F.array_sort(F.collect_set("file")).alias("files"))
    return ends.join(names, "place", "left").crossJoin(found.agg(F.count("*").alias("total"))).select("place", "length", "cycle", "files", "total")


def level_edges(edges: DataFrame, nodes: DataFrame, level: str) -> DataFrame:
    """(src, dst, n, types): edges (src, dst, type) between groups of a level, with how many of each type."""
    tagged = rollup._tagged(edges.select("src", "dst", F.coalesce("type", F.lit("unknown")).alias("type")), nodes.select("id", F.coalesce(F.col(level).cast("string"), F.lit("unknown")).alias("g")), "g").where("a <> b")
    by = tagged.groupBy("a", "b", "type").agg(F.count("*").alias("n"))
    return by.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))


# -- projects


def dependencies(manifests: DataFrame) -> DataFrame:
    """(file, ecosystem, name) of what manifests (file, text) depend on: requirements.txt, pyproject.toml, package.json, Cargo.toml, go.mod. What can't be read gives nothing."""

    def names_of(file: str, text: str) -> list[tuple[str, str]]:
        base = file.rsplit("/", 1)[-1]
        if re.fullmatch(r"requirements[\w.-]*\.txt", base):
            return [("python", m[0].lower()) for line in text.splitlines() if (m := re.match(r"[A-Za-z0-9][\w.-]*", line.strip()))]
        if base == "pyproject.toml":
            out = [q for block in re.findall(r"(?ms)^\s*(?:dependencies|[\w-]+)\s*=\s*\[(.*?)\]", text) for q in re.findall(r"[\"']([A-Za-z0-9][\w.-]*)[^\"']*[\"']", block)]
            for block in re.findall(r"(?ms)^\[tool\.poetry(?:\.group\.[\w-]+)?\.dependencies\]\s*\n(.*?)(?=^\[|\Z)", text):
                out += [n for n in re.findall(r"(?m)^([A-Za-z0-9][\w.-]*)\s*=", block) if n != "python"]
            return [("python", n.lower()) for n in out]
        if base == "package.json":
            try:
                d = json.loads(text)
            except ValueError:
                return []
            return [("javascript", n) for k in ("dependencies", "devDependencies", "peerDependencies") if isinstance(d, dict) and isinstance(d.get(k), dict) for n in d[k]]
        if base == "Cargo.toml":
            return [("rust", n) for block in re.findall(r"(?ms)^\[(?:dev-|build-)?dependencies\]\s*\n(.*?)(?=^\[|\Z)", text) for n in re.findall(r"(?m)^([A-Za-z0-9][\w-]*)\s*=", block)]
        if base == "go.mod":
            return [("go", n) for n in re.findall(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+)\s+v\d", text)]
        return []

    def run(batches):
        for b in batches:
            rows = sorted({(f, *r) for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if f and t for r in names_of(f, t)})
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["file", "ecosystem", "name"])

    return manifests.select("file", "text").mapInArrow(run, "file string, ecosystem string, name string")


def project_report(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``reports.scout`` of files (file, language), with frameworks, package managers, nested packages, whether it is a monorepo (two or more of these), and whether there are tests and continuous integration."""
    base = F.element_at(F.split("file", "/"), -1)
    package = base.isin("package.json", "pyproject.toml", "Cargo.toml", "go.mod") & F.col("file").contains("/")
    manager = F.create_map(*[F.lit(x) for kv in MANAGERS.items() for x in kv])[base]
    more = files.agg(
        F.array_sort(F.collect_set(manager)).alias("package_managers"), F.array_sort(F.collect_set(F.when(package, F.regexp_replace("file", "/[^/]*$", "")))).alias("packages"), (F.count_if(F.col("file").rlike(CI)) > 0).alias("has_ci")
    )
    found = dependencies(manifests).where(F.col("name").isin(*FRAMEWORKS)).agg(F.array_sort(F.collect_set("name")).alias("frameworks"))
    out = reports.scout(files).crossJoin(more).crossJoin(found)
    return out.withColumns({"monorepo": F.size("packages") >= 2, "has_tests": F.col("tests") > 0})


def timed(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of some steps, each written when it is made, and (step, total_ms) of each."""
    out, took = {}, []
    for name, step in steps.items():
        began = time.monotonic()
        out[name] = written(step(), name)
        took.append((name, int((time.monotonic() - began) * 1000)))
    return out, spark.createDataFrame(took, "step string, total_ms long")


def quick_start(files: DataFrame, manifests: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """First look at a project: its report, its graph's summary, its health (dead code and cycles), and vectors of its chunks (id, text) if given; with timings."""
    from graphloom.operators import search

    steps: dict[str, Callable[[], DataFrame]] = {
        "scout": lambda: project_report(files, manifests),
        "dependencies": lambda: tools.graph_summary(nodes, edges),
        "health": lambda: reports.health(dead_code=rollup.dead_code(nodes, edges), cycles=components.simple_cycles(edges, files=nodes)),
    }
    if chunks is not None:
        steps["vectors"] = lambda: search.encoded(chunks)
    return timed(nodes.sparkSession, steps)
