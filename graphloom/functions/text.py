"""Scalar functions: identifiers, paths, documentation references and rule files, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTENSIONS = {
    "py": "python", "pyw": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "rs": "rust", "sql": "sql", "pgsql": "sql", "sh": "bash", "bash": "bash", "json": "json",
    "c": "cpp", "h": "cpp", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "c++": "cpp", "h++": "cpp", "m": "cpp", "mm": "cpp", "md": "markdown", "mdx": "markdown", "mdc": "markdown",
}
#: What documentation names without meaning this code: tools, shell commands, and Python's and generic words.
TOOLS = "pip pip3 pipx uv poetry pdm hatch flit pytest mypy ruff black isort flake8 pylint python python3 ipython jupyter uvicorn gunicorn pydantic fastapi flask django celery alembic npm npx yarn pnpm bun deno node nodejs eslint prettier tsc tsx vite webpack esbuild react vue angular next nuxt remix astro cargo rustc rustup clippy rustfmt git docker make cmake gradle maven curl wget jq yq sed awk grep find ssh scp rsync tar zip unzip gzip vim nvim emacs code cursor subl aws gcloud az kubectl helm terraform pulumi".split()
SHELL = "cd ls pwd mkdir rm cp mv cat head tail echo export source alias which whereis man ps kill top htop df du free chmod chown ln touch nano vi less more xargs tee sort uniq wc cut tr diff patch env printenv exit clear history sudo".split()
WORDS = "True False None and or not is in if elif else for while break continue def class return yield raise try except finally with as import from pass lambda global nonlocal assert del async await print len range str int float bool list dict set tuple type isinstance hasattr getattr setattr open input enumerate zip map filter sorted reversed min max sum any all abs round format repr id hash callable iter next super object property staticmethod classmethod Optional Union List Dict Set Tuple Callable Any TypeVar Generic Literal Final ClassVar example Example test Test TODO FIXME NOTE error Error warning Warning info Info debug Debug name value key data result output input config Config options Options settings Settings foo bar baz qux hello world".split()
PREFIXES = {"python": "py", "typescript": "ts", "tsx": "ts", "javascript": "ts", "rust": "rs", "sql": "sql", "bash": "sh", "json": "json", "cpp": "cpp"}


def file_of(node: Column) -> Column:
    """The path in ``prefix:path::symbol``."""
    return F.split(F.regexp_replace(node, "^[a-z]+:", ""), "::")[0]


def symbol_of(node: Column) -> Column:
    """The symbol in ``prefix:path::symbol``, or null."""
    return F.when(node.contains("::"), F.element_at(F.split(node, "::"), -1))


def short_name(node: Column) -> Column:
    """The last part of the path with the symbol."""
    last = F.element_at(F.split(file_of(node), "/"), -1)
    return F.when(node.contains("::"), F.concat(last, F.lit("::"), symbol_of(node))).otherwise(node)


def language_of(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9+]+)$", 1))]


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def sql_name(name: Column) -> Column:
    """A dotted SQL name: unquoted parts in lower case, quoted ones without quotes."""
    part = lambda p: F.when(p.rlike(r'^["`\[].*["`\]]$'), F.regexp_replace(p, r'^["`\[]|["`\]]$', "")).otherwise(F.lower(p))
    return F.array_join(F.transform(F.split(F.trim(name), r"\."), part), ".")


def ignored(path: Column, names: list[str]) -> Column:
    """Whether a component of a path is in the ignore list or starts with a dot."""
    parts = F.split(path, "/")
    return F.exists(parts, lambda p: p.isin(*names) | p.startswith("."))


def frontmatter(text: Column) -> Column:
    """The ``key: value`` lines between two leading ``---`` lines, as a map."""
    body = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"^[A-Za-z_-]+\s*:"))
    pair = lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([A-Za-z_-]+)\s*:", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[A-Za-z_-]+\s*:(.*)$", 1)).alias("v"))
    return F.map_from_entries(F.transform(lines, pair))


def code_paths(body: Column) -> Column:
    """Distinct paths of files that a text mentions in back-ticks, links or by a folder and an extension; URLs don't count."""
    found = F.flatten(F.array(F.regexp_extract_all(body, F.lit(r"`([A-Za-z0-9_./-]+\.[a-z]{1,5})`"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"\]\(([A-Za-z0-9_./-]+\.[a-z]{1,5})\)"), F.lit(1)), F.regexp_extract_all(body, F.lit(r"\b([A-Za-z0-9_-]+/[A-Za-z0-9_./-]+\.[a-z]{1,5})\b"), F.lit(1))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda p: (F.length(p) >= 4) & ~p.rlike(r"^(https?|www)"))))


def allowed_in_docs(text: Column) -> Column:
    """Whether inline code is a known word, with or without arguments in brackets, a command with arguments, or a dashed package name."""
    known = [*TOOLS, *SHELL, *WORDS]
    t = F.trim(text)
    base, first = F.trim(F.split(t, r"\(")[0]), F.split(t, r"\s+")[0]
    package = t.contains("-") & t.rlike(r"^[\p{L}\p{N}_-]*[\p{L}\p{N}][\p{L}\p{N}_-]*$")
    return t.isin(*known) | base.isin(*known) | first.isin(*TOOLS, *SHELL) | package


def doc_references(docs: DataFrame) -> DataFrame:
    """(doc_file, line, ref_type, raw_text) of documentation (doc_file, text): inline code, fenced blocks with a path, and links to files. Inline code that ``allowed_in_docs`` knows is none."""
    lines = docs.select("doc_file", F.posexplode(F.split("text", "\n")).alias("at", "s")).withColumn("line", F.col("at") + 1)
    code = lines.select("doc_file", "line", F.explode(F.regexp_extract_all("s", F.lit(r"`([^`]+)`"), F.lit(1))).alias("raw_text"))
    r = F.col("raw_text")
    code = code.where(~allowed_in_docs(r))
    kind = F.when(r.rlike(r"^[\w./-]+\.(py|ts|tsx|js|jsx|rs|sql|sh|json|md|yml|yaml|toml)$"), "file_link").when(r.rlike(r"^[A-Za-z_]\w*(\.\w+)*\(.*\)$"), "function_ref").when(r.rlike(r"^[A-Z][a-z0-9]+([A-Z][A-Za-z0-9]*)+$"), "class_ref").otherwise("inline_code")
    links = lines.select("doc_file", "line", F.explode(F.regexp_extract_all("s", F.lit(r"\[[^\]]*\]\(([^)\s]+\.[a-z]{1,5})\)"), F.lit(1))).alias("raw_text")).where(~r.rlike("^https?:"))
    blocks = lines.select("doc_file", "line", F.regexp_extract("s", r"^```(?:[a-z]+:|\d+:\d+:)([\w./-]+)", 1).alias("raw_text")).where("raw_text <> ''")
    return code.withColumn("ref_type", kind).unionByName(links.withColumn("ref_type", F.lit("markdown_link"))).unionByName(blocks.withColumn("ref_type", F.lit("code_block"))).select("doc_file", "line", "ref_type", "raw_text")


def validated_references(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """References with ``found`` and ``confidence`` (of a stale one: high for files, medium for functions and classes, low for other code)."""
    name = F.regexp_replace(F.regexp_replace("raw_text", r"\(.*\)$", ""), r"^.*\.(?=\w+$)", "")
    path = F.col("ref_type").isin("file_link", "markdown_link", "code_block")
    r = refs.withColumn("key", F.when(path, F.regexp_replace("raw_text", r"^\./", "")).otherwise(name))
    r = r.join(files.select(F.col("file").alias("key"), F.lit(True).alias("is_file")).distinct(), "key", "left").join(symbols.select(F.col("name").alias("key"), F.lit(True).alias("is_symbol")).distinct(), "key", "left")
    found = F.coalesce(F.when(path, F.col("is_file")).otherwise(F.col("is_symbol")), F.lit(False))
    return r.select("doc_file", "line", "ref_type", "raw_text", found.alias("found"), F.when(path, "high").when(F.col("ref_type").isin("function_ref", "class_ref"), "medium").otherwise("low").alias("confidence"))


def rule_checks(rules: DataFrame, budget: int = 180) -> DataFrame:
    """(file, number, tokens, short, untitled, over_budget, duplicate_number) of rule files (file, text)."""
    body = F.regexp_replace("text", r"(?s)^---\s*\n.*?\n---\s*", "")
    number = F.expr("try_cast(nullif(regexp_extract(element_at(split(file, '/'), -1), '^([0-9]+)', 1), '') AS INT)")
    r = rules.select("file", number.alias("number"), estimated_tokens(F.col("text")).alias("tokens"), (F.length(F.trim(body)) < 50).alias("short"), (~body.rlike(r"(?m)^# ")).alias("untitled"))
    same = F.count("*").over(Window.partitionBy("number")) > 1
    return r.withColumn("over_budget", F.col("tokens") > 10 * budget).withColumn("duplicate_number", F.col("number").isNotNull() & same)


DIRECTIVES = ((r"(?i)\balways use\b", r"(?i)\bnever use\b"), (r"(?i)\bprefer\b", r"(?i)\bavoid\b"), (r"(?i)\bmust\b(?! not)", r"(?i)\bmust not\b"), (r"(?i)\benable\b", r"(?i)\bdisable\b"))


def globs_overlap(a: Column, b: Column) -> Column:
    """Whether two globs may name the same file: not if both name extensions and share none. A missing glob is every file."""
    every = lambda g: F.coalesce(F.when(F.trim(g) != "", F.trim(g)), F.lit("**/*"))
    a, b = every(a), every(b)
    ends = lambda g: F.regexp_extract_all(g, F.lit(r"\*\.(\w+)"), F.lit(1))
    return (a == "**/*") | (b == "**/*") | (F.size(ends(a)) == 0) | (F.size(ends(b)) == 0) | F.arrays_overlap(ends(a), ends(b))


def rule_conflicts(rules: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """(file_a, file_b, category): pairs of rules that speak of a category with different keywords (``categories``: name to keywords) and whose globs may overlap."""
    text, globs = F.lower("text"), F.regexp_replace(frontmatter(F.col("text"))["globs"], "^[\"']|[\"']$", "")
    mention = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.when(text.contains(k), F.lit(k)) for k in ks]).alias("k")) for c, ks in categories.items()]))
    m = rules.select("file", globs.alias("globs"), mention.alias("m")).select("file", "globs", "m.category", F.array_sort(F.array_compact("m.k")).alias("keys")).where(F.size("keys") > 0)
    a, b = m.select("category", F.col("file").alias("file_a"), F.col("keys").alias("ka"), F.col("globs").alias("ga")), m.select("category", F.col("file").alias("file_b"), F.col("keys").alias("kb"), F.col("globs").alias("gb"))
    return a.join(b, "category").where("file_a < file_b AND ka <> kb").where(globs_overlap(F.col("ga"), F.col("gb"))).select("file_a", "file_b", "category")


def directive_conflicts(rules: DataFrame) -> DataFrame:
    """(pattern, positive, negative): directive pairs of which both sides occur somewhere in the rules."""
    t = F.col("text")
    n = rules.agg(*[F.count_if(t.rlike(p)).alias(f"p{i}") for i, (p, _) in enumerate(DIRECTIVES)], *[F.count_if(t.rlike(q)).alias(f"q{i}") for i, (_, q) in enumerate(DIRECTIVES)])
    rows = F.array(*[F.struct(F.lit(i).alias("pattern"), F.col(f"p{i}").alias("positive"), F.col(f"q{i}").alias("negative")) for i in range(len(DIRECTIVES))])
    return n.select(F.explode(rows).alias("x")).select("x.*").where("positive > 0 AND negative > 0")


#: Most characters of rules that are sent to every executor.
RULE_CHARS = 50_000_000


def path_coverage(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, covered): whether a path, or a folder above it, is named in any rule (text). Rules of more than RULE_CHARS characters together are refused, as all of them meet every path."""
    if (rules.agg(F.sum(F.length("text"))).first()[0] or 0) > RULE_CHARS:
        raise ValueError(f"rules of more than {RULE_CHARS} characters")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    t = targets.select("path", above.alias("above"))
    hit = t.join(F.broadcast(rules.select("text")), F.exists("above", lambda a: F.col("text").contains(a)), "left_semi").select("path", F.lit(True).alias("c"))
    return targets.select("path").join(hit.distinct(), "path", "left").select("path", F.coalesce("c", F.lit(False)).alias("covered"))
