"""What is around the code of a project: languages, ignore lists, rule files, path aliases, schema fields, a registry of analyses."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import code as C
from graphloom.functions import text as T

#: Languages in the order in which they are reported.
LANGUAGES = ["python", "typescript", "rust", "sql", "bash", "json", "cpp"]
IGNORES = (
    ".git .svn .hg node_modules vendor bower_components __pycache__ .pytest_cache .mypy_cache .ruff_cache .tox *.egg-info .eggs venv .venv env .env dist build .idea .vscode coverage .coverage htmlcov .nyc_output"
).split()
FRAMEWORKS = {
    "next": [".next", "out"], "nuxt": [".nuxt", ".output"], "vite": [".vite"], "gatsby": [".cache", "public"], "remix": [".cache", "build"], "astro": [".astro"], "sveltekit": [".svelte-kit"], "webpack": ["dist"], "parcel": [".parcel-cache"],
    "turbo": [".turbo"], "nx": [".nx"], "pytest": [".pytest_cache"], "django": ["staticfiles", "media"], "flask": ["instance"], "rust": ["target"], "cargo": ["target"], "docker": [".docker"],
}
LANGUAGE_IGNORES = {"rust": ["target"], "go": ["bin", "pkg"], "java": ["target", "out", ".gradle"], "csharp": ["bin", "obj"]}
#: Where rule files are, by the assistant that reads them.
RULES = {"cursor": r"^\.cursor/rules/[^/]+\.mdc$", "opencode": r"^(AGENTS|CLAUDE)\.md$", "claude": r"^\.claude/(CLAUDE\.md|rules/.*\.md)$"}
FIELDS = "file string, owner string, name string, type string, nullable boolean, is_primary_key boolean, references string"


def detect_languages(files: DataFrame) -> DataFrame:
    """(language, place) of the languages that a tree (file) has, in the fixed order of LANGUAGES; JavaScript and TSX count as TypeScript."""
    lang = T.language_of(F.col("file"))
    lang = F.when(lang.isin("javascript", "tsx"), "typescript").otherwise(lang)
    place = F.create_map(*[F.lit(x) for k, v in enumerate(LANGUAGES) for x in (v, k + 1)])
    return files.select(lang.alias("language")).where(F.col("language").isin(*LANGUAGES)).distinct().withColumn("place", place[F.col("language")])


def suggested_ignores(frameworks: Column, languages: Column) -> Column:
    """Sorted patterns to ignore: the usual ones, those of frameworks and of languages (arrays of names in any case)."""
    table = lambda m: F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    of = lambda names, m: F.flatten(F.transform(names, lambda n: F.coalesce(F.try_element_at(table(m), F.lower(n)), F.array().cast("array<string>"))))
    return F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, IGNORES)), of(frameworks, FRAMEWORKS), of(languages, LANGUAGE_IGNORES))))


def ignore_file(patterns: list[str], name: str = "this project") -> str:
    """The text of an ignore file in the syntax of gitignore."""
    return f"# Files and folders of {name} that are not analysed; one pattern a line, as in .gitignore.\n" + "".join(f"{p}\n" for p in sorted(set(patterns)))


def discovered_rules(files: DataFrame, sources: list[str] | None = None, custom: str | None = None) -> DataFrame:
    """(source, file, text) of the rule files of a tree (file, text), or of all Markdown below a custom path (or that file itself). Empty front matter is kept in the text."""
    if custom:
        at = custom.rstrip("/")
        return files.where(((F.col("file") == at) | F.col("file").startswith(at + "/")) & F.col("file").rlike(r"\.mdc?$")).select(F.lit("custom").alias("source"), "file", "text")
    kind = None
    for name in sources or list(RULES):
        hit = F.col("file").rlike(RULES[name])
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return files.select(kind.alias("source"), "file", "text").where("source IS NOT NULL")


def git_summary(commits: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """One row of commits (commit_id, author, at): commits in the last days before ``now``, and contributors of all time."""
    return commits.agg(F.countDistinct(F.when(F.col("at") >= now - F.expr(f"INTERVAL {days} DAYS"), F.col("commit_id"))).alias("recent_commits"), F.countDistinct("author").alias("contributors"))


# -- schema fields


def _python_fields(file: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for c in ast.walk(tree):
        if isinstance(c, ast.ClassDef):
            for s in c.body:
                if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                    kind = ast.unparse(s.annotation)
                    yield file, c.name, s.target.id, kind, bool(re.search(r"\bOptional\b|\bNone\b", kind)), False, None


_TS_TYPE = re.compile(r"(?:export\s+)?(?:interface\s+(\w+)[^{]*|type\s+(\w+)\s*=\s*)\{([^{}]*)\}")
_TS_FIELD = re.compile(r"(?:readonly\s+)?(\w+)(\?)?\s*:\s*([^;,\n]+)")
_RUST_TYPE = re.compile(r"struct\s+(\w+)(?:<[^>]*>)?\s*\{([^{}]*)\}")
_RUST_FIELD = re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^\n]+?),?\s*(?:\n|$)")
_SQL_TABLE = re.compile(r"create\s+(?:temp\s+|temporary\s+|unlogged\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(", re.I)


def _sql_parts(text: str, at: int) -> list[str]:
    """The parts of a bracketed list that begins before ``at``, cut at its own commas."""
    depth, start, parts = 1, at, []
    for k in range(at, len(text)):
        c = text[k]
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if depth == 0 or depth == 1 and c == ",":
            parts.append(text[start:k].strip())
            start = k + 1
        if depth == 0:
            break
    return [p for p in parts if p]


def _sql_fields(file: str, text: str) -> Iterator[tuple]:
    text = re.sub(r"--[^\n]*", "", text)
    clean = lambda s: s.strip().strip('"`[]')
    for m in _SQL_TABLE.finditer(text):
        table, rows, keys, refs = clean(m[1]), [], set(), {}
        for p in _sql_parts(text, m.end()):
            if k := re.match(r"(?:constraint\s+\S+\s+)?primary\s+key\s*\(([^)]*)\)", p, re.I):
                keys |= {clean(x) for x in k[1].split(",")}
            elif k := re.match(r"(?:constraint\s+\S+\s+)?foreign\s+key\s*\(([^)]*)\)\s*references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?", p, re.I):
                own, to = [clean(x) for x in k[1].split(",")], [clean(x) for x in (k[3] or "").split(",")]
                refs |= {a: clean(k[2]) + (f".{b}" if b else "") for a, b in zip(own, to + [""] * len(own))}
            elif not re.match(r"(constraint|unique|check|exclude|like|primary|foreign)\b", p, re.I) and (k := re.match(r"([\w\"`\[\]]+)\s+([A-Za-z_][\w ]*?(?:\([^)]*\))?(?:\[\])?)(?=\s+(?:not|null|default|primary|references|unique|check|generated|collate|constraint)\b|\s*$)(.*)$", p, re.I | re.S)):
                to = re.search(r"references\s+([\w.\"`]+)\s*(?:\(([^)]*)\))?", k[3], re.I)
                if re.search(r"primary\s+key", k[3], re.I):
                    keys.add(clean(k[1]))
                if to:
                    refs[clean(k[1])] = clean(to[1]) + (f".{clean(to[2])}" if to[2] else "")
                rows.append((clean(k[1]), " ".join(k[2].split()), not re.search(r"not\s+null", k[3], re.I)))
        for name, kind, nullable in rows:
            yield file, table, name, kind, nullable and name not in keys, name in keys, refs.get(name)


def _json_fields(file: str, text: str) -> Iterator[tuple]:
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return
    names = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
    for k, v in value.items() if isinstance(value, dict) else ():
        yield file, file.rsplit("/", 1)[-1], k, names[type(v)], v is None, False, None


def fields_of(file: str, text: str) -> list[tuple]:
    """Fields of the classes, interfaces, structs, tables or top object of one file, see FIELDS."""
    ext = file.rsplit(".", 1)[-1].lower()
    if ext in ("py", "pyw"):
        return list(_python_fields(file, text))
    if ext in ("ts", "tsx"):
        return [(file, m[1] or m[2], f[1], f[3].strip(), bool(f[2]) or bool(re.search(r"\b(null|undefined)\b", f[3])), False, None) for m in _TS_TYPE.finditer(text) for f in _TS_FIELD.finditer(m[3])]
    if ext == "rs":
        return [(file, m[1], f[1], f[2].strip(), f[2].strip().startswith("Option<"), False, None) for m in _RUST_TYPE.finditer(text) for f in _RUST_FIELD.finditer(m[2].strip() + "\n")]
    if ext in ("sql", "pgsql"):
        return list(_sql_fields(file, text))
    return list(_json_fields(file, text)) if ext == "json" else []


def schema_fields(files: DataFrame) -> DataFrame:
    """The fields of all files (file, text)."""
    names = [c.split()[0] for c in FIELDS.split(", ")]
    types = [pa.bool_() if c.endswith("boolean") else pa.string() for c in FIELDS.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if f and t for r in fields_of(f, t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return files.select("file", "text").mapInArrow(run, FIELDS)


def foreign_keys(fields: DataFrame) -> DataFrame:
    """Edges (src, dst, type) from tables to the tables that their columns refer to."""
    return fields.where(F.col("references").isNotNull()).select(F.col("owner").alias("src"), F.regexp_replace("references", r"\.[^.]*$", "").alias("dst"), F.lit("references").alias("type")).distinct()


# -- path aliases


def alias_table(configs: DataFrame) -> DataFrame:
    """(folder, prefix, suffix, target, place) of the path aliases of tsconfig files (file, text); comments, trailing commas and ``extends`` within the tree are seen to.

    A configuration without paths of its own takes those of the one it extends. Configurations are small and come together in one task for a folder tree of any size: only they, never sources.
    """

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", t or "", flags=re.S)
                try:
                    known[f] = json.loads(re.sub(r",\s*([}\]])", r"\1", t))
                except ValueError:
                    continue
        rows = []
        for f in sorted(known):
            own, at, seen = known[f], f, set()
            while not (own.get("compilerOptions") or {}).get("paths") and isinstance(own.get("extends"), str) and at not in seen:
                seen.add(at)
                at = _joined(at.rpartition("/")[0], own["extends"] + ("" if own["extends"].endswith(".json") else ".json"))
                if at not in known:
                    break
                own = known[at]
            options = own.get("compilerOptions") or {}
            base = _joined(at.rpartition("/")[0], options.get("baseUrl", "."))
            for pattern, targets in (options.get("paths") or {}).items():
                prefix, star, suffix = pattern.partition("*")
                rows += [(f.rpartition("/")[0], prefix, suffix if star else None, _joined(base, to), k) for k, to in enumerate(targets)]
        columns = list(zip(*rows)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (*[pa.string()] * 4, pa.int32()))], names=["folder", "prefix", "suffix", "target", "place"])

    return configs.select("file", "text").coalesce(1).mapInArrow(run, "folder string, prefix string, suffix string, target string, place int")


def _joined(folder: str, path: str) -> str:
    out: list[str] = [] if path.startswith("/") else [p for p in folder.split("/") if p]
    for p in path.split("/"):
        if p == "..":
            out = out[:-1]
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def resolve_aliases(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(file, module, target): imports (file, module) by an alias of the nearest configuration above, led to a file of the tree; the longest prefix wins, then the first target that is there."""
    a = F.broadcast(aliases)
    mid = F.expr("substring(module, length(prefix) + 1, length(module) - length(prefix) - length(coalesce(suffix, '')))")
    near = (F.col("folder") == "") | F.col("file").startswith(F.concat("folder", F.lit("/")))
    hit = F.when(F.col("suffix").isNull(), F.col("module") == F.col("prefix")).otherwise(F.col("module").startswith(F.col("prefix")) & F.col("module").endswith(F.col("suffix")) & (F.length("module") >= F.length("prefix") + F.length("suffix")))
    m = imports.join(a, near & hit).withColumn("path", F.when(F.col("suffix").isNull(), F.col("target")).otherwise(F.replace("target", F.lit("*"), mid)))
    ends = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
    m = m.select("file", "module", (-F.length("folder")).alias("f"), (-F.length("prefix")).alias("p"), "place", F.posexplode(F.array(*[F.concat("path", F.lit(e)) for e in ends])).alias("e", "target"))
    there = m.join(files.select(F.col("file").alias("target")).distinct(), "target", "left_semi")
    return there.groupBy("file", "module").agg(F.min_by("target", F.struct("f", "p", "place", "e")).alias("target"))


# -- registry and caches


def repo_hash(path: Column) -> Column:
    """The name of a repository's cache folder."""
    return C.short_hash(path)


class Registry:
    """Analysed repositories: (hash, path, at), one row each, in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(self.folder)
        return path, at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def register(self, path: str, at: str) -> None:
        """Add a repository or renew its time."""
        row = self.spark.createDataFrame([(path, at)], "path string, at string").withColumn("hash", repo_hash(F.col("path")))
        row.select("path", "at", "hash").write.partitionBy("hash").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.folder)

    def unregister(self, path: str) -> bool:
        """Remove a repository; whether it was there."""
        name = self.spark.range(1).select(repo_hash(F.lit(path)).alias("h")).first()["h"]
        make, fs, _ = self._fs()
        return bool(fs.delete(make(f"{self.folder}/hash={name}"), True))

    def listed(self) -> DataFrame:
        _, fs, at = self._fs()
        if not fs.exists(at) or not any(x.isDirectory() for x in fs.listStatus(at)):
            return self.spark.createDataFrame([], "hash string, path string, at string")
        return self.spark.read.schema("path string, at string, hash string").parquet(self.folder).select("hash", "path", "at")

    def sizes(self, cache: str) -> DataFrame:
        """(hash, path, bytes, size) of the cache folders of registered repositories; missing ones have 0."""
        make, fs, _ = self._fs()
        rows = []
        for r in self.listed().toLocalIterator():  # a row a repository
            at = make(f"{cache.rstrip('/')}/{r['hash']}")
            rows.append((r["hash"], r["path"], fs.getContentSummary(at).getLength() if fs.exists(at) else 0))
        return self.spark.createDataFrame(rows, "hash string, path string, bytes long").withColumn("size", C.format_size(F.col("bytes")))

    def clear(self, cache: str, path: str) -> bool:
        """Remove a repository's cache folder; whether it was there."""
        name = self.spark.range(1).select(repo_hash(F.lit(path)).alias("h")).first()["h"]
        make, fs, _ = self._fs()
        return bool(fs.delete(make(f"{cache.rstrip('/')}/{name}"), True))
