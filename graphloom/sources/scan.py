"""Source trees as tables: every file is read once, in the cluster, and parsed to nodes, edges and string occurrences.

Python is parsed with its own grammar; the other languages by patterns, which see declarations, imports and calls of names that a file declares itself, but no nesting. A file that can't be parsed gives an error row.
"""

from __future__ import annotations

import ast
import hashlib
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import EXTENSIONS, PREFIXES
from graphloom.session import written

SKIP = "node_modules __pycache__ venv env dist build target coverage vendor site-packages out".split()
ROWS = "kind string, file string, language string, id string, type string, name string, line int, exported boolean, src string, dst string, resolved boolean, value string, context string, scope string, error string"
_COLUMNS = [c.split()[0] for c in ROWS.split(", ")]
_PATTERNS: dict[str, dict[str, str]] = {
    "typescript": {
        "function": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|^[ \t]*(?:export\s+)?(?:const|let)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?\([^)\n]*\)\s*(?::[^=\n]+)?=>",
        "class": r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+([A-Za-z_$][\w$]*)",
        "constant": r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\b",
        "import": r"(?:^|\n)\s*(?:import|export)\s[^'\"\n;]*?from\s*['\"]([^'\"]+)['\"]|(?:^|\n)\s*import\s*['\"]([^'\"]+)['\"]|require\(\s*['\"]([^'\"]+)['\"]\s*\)",
        "extends": r"class\s+([A-Za-z_$][\w$]*)\s+extends\s+([A-Za-z_$][\w$.]*)",
    },
    "rust": {
        "function": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)",
        "class": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)",
        "constant": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+([A-Z][A-Z0-9_]*)\s*:",
        "import": r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)|^[ \t]*(?:pub\s+)?mod\s+(\w+)\s*;",
    },
    "bash": {"function": r"^[ \t]*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)|^[ \t]*function\s+([A-Za-z_]\w*)", "constant": r"^(?:readonly\s+|export\s+)?([A-Z][A-Z0-9_]*)=", "import": r"^[ \t]*(?:source|\.)\s+[\"']?([^\s\"']+)|^[ \t]*(?:ba)?sh\s+(\S+\.sh)"},
    "cpp": {
        "function": r"^[A-Za-z_][\w:<>,*& \t]*?[ \t*&]([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:const\s*)?\{",
        "class": r"^[ \t]*(?:template\s*<[^>]*>\s*)?(?:class|struct)\s+([A-Za-z_]\w*)\s*(?::[^{;]*)?\{",
        "constant": r"^[ \t]*#define\s+([A-Z][A-Z0-9_]*)\b|^[ \t]*(?:static\s+)?const(?:expr)?\s+\w+\s+([A-Z][A-Z0-9_]*)\s*=",
        "import": r"^[ \t]*#\s*include\s*[\"<]([^\">]+)[\">]",
    },
}
_PATTERNS["javascript"] = _PATTERNS["tsx"] = _PATTERNS["typescript"]
_SQL_NAME = r"((?:[\"`\[]?\w+[\"`\]]?\.)*[\"`\[]?\w+[\"`\]]?)"
_SQL_DEFINITION = re.compile(rf"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?{_SQL_NAME}", re.I)
_SQL_TABLE = re.compile(rf"\b(?:from|join|into|update|references|on\s+table)\s+{_SQL_NAME}", re.I)
_SQL_CALL = re.compile(rf"\b(?:call|execute|perform)\s+{_SQL_NAME}\s*\(", re.I)
_SQL_CTE = re.compile(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)(\w+)\s+as\s*\(", re.I)


def split_sql(source: str) -> list[tuple[str, int]]:
    """(statement, its start) of SQL, cut at semicolons outside quotes, dollar quotes and comments."""
    out, start, i, n = [], 0, 0, len(source)
    skip = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$(\w*)\$.*?\$\1\$|;", re.S)
    while i < n:
        m = skip.search(source, i)
        if not m:
            break
        i = m.end()
        if m[0] == ";":
            if source[start : m.start()].strip():
                out.append((source[start : m.start()].strip(), start))
            start = i
    if source[start:].strip():
        out.append((source[start:].strip(), start))
    return out


def _clean_sql(s: str) -> str:
    return ".".join(p.strip('"`[]') if p[:1] in '"`[' else p.lower() for p in s.split("."))


class _Rows:
    """Collects the rows of one file."""

    def __init__(self, file: str, language: str):
        self.file, self.language, self.prefix, self.rows = file, language, PREFIXES.get(language, language), []
        self.module = f"{self.prefix}:{file}"

    def add(self, kind: str, **fields) -> None:
        self.rows.append({**dict.fromkeys(_COLUMNS), "kind": kind, "file": self.file, "language": self.language, **fields})

    def node(self, type: str, name: str, line: int, exported: bool = True) -> str:
        i = f"{self.module}::{name}"
        self.add("node", id=i, type=type, name=name, line=line, exported=exported)
        self.edge(self.module, i, "contains", True)
        return i

    def edge(self, src: str, dst: str, type: str, resolved: bool) -> None:
        if src and dst:
            self.add("edge", src=src, dst=dst, type=type, resolved=resolved)

    def string(self, value: str, line: int, context: str, scope: str | None) -> None:
        if len(value) >= 2 and value.strip():
            self.add("string", value=value, line=line, context=context, scope=scope)


def _relative(file: str, level: int, module: str | None) -> str:
    """A dotted name of a relative import, from the root of the tree."""
    parts = file.split("/")[:-1]
    parts = parts[: len(parts) - (level - 1)] if level > 1 else parts
    return ".".join([*parts, *([module] if module else [])])


class _Python(ast.NodeVisitor):
    def __init__(self, rows: _Rows):
        self.out, self.stack, self.calls = rows, [], []

    def _define(self, n: ast.AST, type: str) -> None:
        i = self.out.node(type, n.name, n.lineno, not n.name.startswith("_"))
        if type == "class" and n.bases and isinstance(n.bases[0], (ast.Name, ast.Attribute)):
            b = n.bases[0]
            self.out.edge(i, b.id if isinstance(b, ast.Name) else b.attr, "extends", False)
        self.stack.append(n.name)
        self.generic_visit(n)
        self.stack.pop()

    def visit_FunctionDef(self, n):
        self._define(n, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, n):
        self._define(n, "class")

    def visit_Import(self, n):
        for a in n.names:
            self.out.edge(self.out.module, a.name, "imports", False)

    def visit_ImportFrom(self, n):
        m = _relative(self.out.file, n.level, n.module) if n.level else n.module
        self.out.edge(self.out.module, m, "imports", False)
        for a in n.names:
            if a.name != "*":
                self.out.edge(self.out.module, f"{m}::{a.name}", "imports_symbol", False)

    def visit_Call(self, n):
        if isinstance(n.func, ast.Name) and self.stack:
            self.calls.append((self.stack[-1], n.func.id))
        name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else "call"
        for a in [*n.args, *[k.value for k in n.keywords]]:
            self._string(a, name)
        self.generic_visit(n)

    def _string(self, n: ast.AST | None, context: str) -> None:
        parts = n.values if isinstance(n, ast.JoinedStr) else [n]
        for p in parts:
            if isinstance(p, ast.Constant) and isinstance(p.value, str):
                self.out.string(p.value, p.lineno, context, self.stack[-1] if self.stack else None)

    def visit_Assign(self, n):
        for t in n.targets:
            if isinstance(t, ast.Name):
                self._string(n.value, t.id)
                if not self.stack and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                    self.out.node("constant", t.id, n.lineno, not t.id.startswith("_"))
        self.generic_visit(n)

    def visit_AnnAssign(self, n):
        if isinstance(n.target, ast.Name):
            self._string(n.value, n.target.id)
        self.generic_visit(n)

    def visit_Return(self, n):
        self._string(n.value, "return")
        self.generic_visit(n)

    def visit_Dict(self, n):
        for k, v in zip(n.keys, n.values):
            self._string(k, "key")
            self._string(v, "value")
        self.generic_visit(n)


def _parse_python(rows: _Rows, source: str) -> None:
    v = _Python(rows)
    v.visit(ast.parse(source))
    names = {r["name"] for r in rows.rows if r["kind"] == "node"}
    for caller, callee in dict.fromkeys(v.calls):
        if callee in names and callee != caller:
            rows.edge(f"{rows.module}::{caller}", f"{rows.module}::{callee}", "calls", True)


def _parse_sql(rows: _Rows, source: str) -> None:
    statements = split_sql(source)
    known: dict[str, str] = {}
    for s, at in statements:
        for m in _SQL_DEFINITION.finditer(s):
            name = _clean_sql(m[2])
            i = f"sql:{rows.file}::{m[1].lower()}::{name}"
            known[name] = i
            rows.add("node", id=i, type=m[1].lower(), name=name, line=source.count("\n", 0, at) + 1, exported=True)
            rows.edge(rows.module, i, "contains", True)
    for k, (s, _) in enumerate(statements):
        d = _SQL_DEFINITION.search(s)
        src = known[_clean_sql(d[2])] if d else rows.module
        ctes = {m[1].lower(): f"sql:{rows.file}::cte::{k}::{m[1].lower()}" for m in _SQL_CTE.finditer(s)}
        for name, i in ctes.items():
            rows.add("node", id=i, type="cte", name=name, line=None, exported=False)
        seen = set()
        for pattern, type in ((_SQL_TABLE, "references"), (_SQL_CALL, "calls")):
            for m in pattern.finditer(s):
                name = _clean_sql(m[1])
                dst = ctes.get(name) or known.get(name) or name
                if dst != src and name not in ("select", "set") and (dst, type) not in seen:
                    seen.add((dst, type))
                    rows.edge(src, dst, type, dst != name)
        for m in re.finditer(r"'((?:[^']|'')*)'", s):
            rows.string(m[1].replace("''", "'"), 0, s.split(None, 1)[0].lower(), None)


def _parse_patterns(rows: _Rows, source: str) -> None:
    defined: list[tuple[int, str]] = []
    line = lambda at: source.count("\n", 0, at) + 1
    for type in ("function", "class", "constant"):
        for m in re.finditer(_PATTERNS[rows.language].get(type, r"(?!)"), source, re.M):
            name = next(g for g in m.groups() if g)
            if name not in ("if", "for", "while", "switch", "return"):
                rows.node(type, name, line(m.start(m.lastindex or 0)), m[0].lstrip().startswith(("export", "pub")) or rows.language in ("bash", "cpp"))
                if type == "function":
                    defined.append((m.start(), name))
    for m in re.finditer(_PATTERNS[rows.language]["import"], source, re.M):
        rows.edge(rows.module, next((g for g in m.groups() if g), ""), "imports", False)
    if "extends" in _PATTERNS[rows.language]:
        for m in re.finditer(_PATTERNS[rows.language]["extends"], source):
            rows.edge(f"{rows.module}::{m[1]}", m[2], "extends", False)
    defined.sort()
    names = {n for _, n in defined}
    for (start, caller), end in zip(defined, [s for s, _ in defined[1:]] + [len(source)]):
        call = r"(?m)(?:^|[;&|(]|\$\()[ \t]*([A-Za-z_]\w*)\b" if rows.language == "bash" else r"\b([A-Za-z_$][\w$]*)\s*\("
        for callee in dict.fromkeys(re.findall(call, source[start:end])):
            if callee in names and callee != caller:
                rows.edge(f"{rows.module}::{caller}", f"{rows.module}::{callee}", "calls", True)
    for m in re.finditer(r"(\w+)?\s*[(=:,]\s*(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`$]*`)", source):
        scope = next((n for s, n in reversed(defined) if s <= m.start()), None)
        rows.string(m[2][1:-1], line(m.start()), m[1] or "", scope)


def parse_file(file: str, source: str) -> list[dict]:
    """All rows of one file, see ROWS: its module, its nodes, edges and strings, or an error."""
    language = EXTENSIONS.get(posixpath.splitext(file)[1].lstrip(".").lower())
    if language is None:
        return []
    rows = _Rows(file, language)
    rows.add("node", id=rows.module, type="config" if language == "json" else "module", name=posixpath.basename(file), line=1, exported=True)
    try:
        if language == "python":
            _parse_python(rows, source)
        elif language == "sql":
            _parse_sql(rows, source)
        elif language in _PATTERNS:
            _parse_patterns(rows, source)
    except (SyntaxError, ValueError, RecursionError) as e:
        rows.add("error", error=f"{type(e).__name__}: {e}")
    return rows.rows


def files(spark: SparkSession, root: str, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(file, content, size, mtime, hash) of the source files below a folder; components in the ignore list or with a leading dot are skipped, counted from the root."""
    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(re.sub("^file:/*", "/", root)) + "/", "")
    lang = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.lower(F.regexp_extract(rel, r"\.([A-Za-z0-9+]+)$", 1))]
    out = raw.select(rel.alias("file"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), lang.alias("language"))
    skip = SKIP if exclude is None else exclude
    out = out.where(F.col("language").isNotNull() & ~F.exists(F.split("file", "/"), lambda p: p.isin(*skip) | p.startswith(".")))
    if languages:
        out = out.where(F.col("language").isin(*languages, *(["tsx"] if "typescript" in languages else [])))
    return out


def parsed(found: DataFrame) -> DataFrame:
    """The rows of all files, see ROWS."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [r for f, c in zip(p["file"], p["content"]) for r in parse_file(f, bytes(c).decode("utf-8", "replace"))]
            df = pd.DataFrame(rows, columns=_COLUMNS)
            df["line"] = df["line"].astype("Int32")
            yield df

    return found.select("file", "content").mapInPandas(run, ROWS)


def resolve_imports(rows: DataFrame) -> DataFrame:
    """Edges of ``parsed`` rows (src, dst, type, resolved) with imports led to the files they name, if those are there, and ``extends`` to the last class of that name."""
    modules = rows.where("kind = 'node' AND type = 'module'").select(F.col("id").alias("to"), F.col("file").alias("path"))
    stem = F.regexp_replace("path", r"(/__init__\.py|/index\.[jt]sx?|/mod\.rs|\.[A-Za-z]+)$", "")
    known = modules.select("to", F.explode(F.array_distinct(F.array("path", stem))).alias("key")).groupBy("key").agg(F.min("to").alias("to"))
    e = rows.where("kind = 'edge'").select("file", "language", "src", "dst", "type", "resolved")
    target = F.split("dst", "::")[0]
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    dotted = F.regexp_replace(target, r"\.", "/")
    near = F.regexp_replace(F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace(target, r"^\./", "")), r"(^|/)[^/.]+/\.\./", "$1")
    rust = F.regexp_replace(F.regexp_replace(F.col("dst"), r"^(crate|self|super)::", ""), "::", "/")
    key = F.when(F.col("language") == "python", dotted).when(F.col("language") == "rust", F.concat_ws("/", F.when(folder != "", folder), F.element_at(F.split(rust, "/"), 1))).otherwise(near)
    e = e.withColumn("key", F.when(F.col("type").isin("imports", "imports_symbol") & ~F.col("resolved"), key)).join(known, "key", "left")
    classes = rows.where("kind = 'node' AND type = 'class'").groupBy("name").agg(F.max(F.struct("file", "line", "id")).alias("m")).select(F.col("name").alias("base"), F.col("m.id").alias("cls"))
    e = e.join(classes, (F.col("dst") == F.col("base")) & (F.col("type") == "extends") & ~F.col("resolved"), "left")
    symbol = F.when((F.col("type") == "imports_symbol") & F.col("to").isNotNull(), F.concat("to", F.lit("::"), F.element_at(F.split("dst", "::"), -1)))
    dst = F.coalesce(symbol, "to", "cls", "dst")
    return e.select("src", dst.alias("dst"), "type", (F.col("resolved") | F.col("to").isNotNull() | F.col("cls").isNotNull()).alias("resolved"))


def graph(spark: SparkSession, root: str, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a source tree."""
    rows = parsed(files(spark, root, **options))
    return rows.where("kind = 'node'").select("id", "type", "file", "name", "line", "exported", "language").dropDuplicates(["id"]), resolve_imports(rows)


def strings(rows: DataFrame) -> DataFrame:
    """(value, file, call_site, scope, line) of ``parsed`` rows."""
    return rows.where("kind = 'string'").select("value", "file", F.col("context").alias("call_site"), "scope", "line")


def commit_log(lines: DataFrame, mark: str = "---COMMIT---") -> DataFrame:
    """(commit_id, file) of a log (at, line): file names between marks; commits without files give no rows.

    Marks are counted within ranges of the log, and each range goes on from those before it, so no task holds the whole log.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = written(lines.select("at", "line").repartitionByRange(parts, "at").withColumn("part", F.spark_partition_id()), "log")
    is_mark = (F.col("line") == mark).cast("int")
    sums = split.groupBy("part").agg(F.sum(is_mark).alias("n"))  # one row a range
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.sum(is_mark).over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    rows = split.join(F.broadcast(before), "part").withColumn("commit_id", own + F.col("before"))
    return rows.where((F.col("line") != mark) & (F.trim("line") != "")).select("commit_id", F.col("line").alias("file"))


def json_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON graph; edge ends may be called from and to, or source and target."""
    raw = spark.read.option("multiLine", "true").json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    e = raw.select(F.explode("edges").alias("e")).select("e.*")
    pick = lambda *cs: F.coalesce(*[F.col(f"`{c}`") for c in cs if c in e.columns])
    kind = F.coalesce(F.col("type"), F.lit("unknown")) if "type" in e.columns else F.lit("unknown")
    return nodes, e.select(pick("src", "from", "source").alias("src"), pick("dst", "to", "target").alias("dst"), kind.alias("type"))


def content_hash(data: bytes) -> str:
    """The hash that ``files`` gives."""
    return hashlib.sha256(data).hexdigest()
