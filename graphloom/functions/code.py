"""Source code as rows: chunks to search by, blocks to find duplicates among, and the small text functions around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest lines of code of a chunk that isn't trivial, of a package marker, and lines and characters of a snippet.
CODE_LINES, MARKER_LINES, SNIPPET_LINES, SNIPPET_CHARS = 5, 3, 5, 300
CHUNKS = "id string, file string, type string, name string, content string, line_start int, line_end int"
BLOCKS = "file string, line_start int, line_end int, content string"
#: What a block begins with, by language.
_STARTS = {
    "python": ("def ", "class "),
    "javascript": ("function ", "const ", "class ", "export function ", "export const "),
    "typescript": ("function ", "const ", "class ", "interface ", "type ", "export function ", "export const ", "export class "),
    "rust": ("fn ", "struct ", "enum ", "impl ", "const ", "static ", "pub fn ", "pub struct "),
    "bash": ("function ", "() {"),
}
_LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".rs": "rust", ".sh": "bash", ".bash": "bash"}
_DEFINITION = {
    ".py": re.compile(r"(?P<kind>async def|def|class)\s+(?P<name>[^(:]*)"),
    ".js": re.compile(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?P<kind>function|class)\s*\*?\s+(?P<name>[\w$]+)|(?:export\s+)?(?:const|let|var)\s+(?P<arrow>[\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>"),
    ".rs": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?P<kind>fn|struct|enum|trait|impl)\b\s*(?:<[^>]*>\s*)?(?P<name>\w+)"),
    ".sh": re.compile(r"(?P<kind>function)\s+(?P<name>[\w-]+)|(?P<arrow>[\w-]+)\s*\(\)\s*\{?"),
    ".sql": re.compile(r"create\s+(?:or\s+replace\s+)?(?:temp\s+|temporary\s+|materialized\s+)*(?P<kind>table|view|function|procedure|trigger)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`\[\]]+)", re.I),
}
for _same, _of in ((".pyw", ".py"), (".ts", ".js"), (".tsx", ".js"), (".jsx", ".js"), (".mjs", ".js"), (".cjs", ".js"), (".bash", ".sh"), (".pgsql", ".sql")):
    _DEFINITION[_same] = _DEFINITION[_of]
_MARK = {".py": "py", ".pyw": "py", ".rs": "rs", ".sql": "sql", ".pgsql": "sql", ".sh": "sh", ".bash": "sh"}


def _suffix(file: str) -> str:
    name = file.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name else ""


def _ends_by_indent(lines: list[str], at: int) -> int:
    """The line after a block that goes on while lines are blank or indented further."""
    depth = len(lines[at]) - len(lines[at].lstrip())
    k = at + 1
    while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip()) > depth):
        k += 1
    return k


def _ends_by_braces(lines: list[str], at: int) -> int:
    """The line after the one in which all braces that were opened are closed; one line if there are none within three."""
    depth, opened, k = 0, False, at
    while k < len(lines):
        opened |= "{" in lines[k]
        depth += lines[k].count("{") - lines[k].count("}")
        k += 1
        if opened and depth <= 0 or not opened and k >= at + 3:
            return k if opened else at + 1
    return k


def chunks_of(file: str, text: str, by: str = "function", most: int | None = None) -> list[tuple]:
    """Chunks of one file, see CHUNKS: its functions and classes (or SQL objects), or the whole file if there are none or ``by`` is ``file``.

    A chunk's content is whole, or cut to ``most`` characters if given, as encoders with a short input want it.
    """
    if not text.strip():
        return []
    lines = text.split("\n")
    found = []
    suffix = _suffix(file)
    pattern = _DEFINITION.get(suffix)
    if by != "file" and pattern:
        end = {".py": _ends_by_indent, ".pyw": _ends_by_indent}.get(suffix, _ends_by_braces)
        for k, line in enumerate(lines):
            m = pattern.match(line.lstrip())
            name = (m["name"] or m.groupdict().get("arrow") or "").strip() if m else ""
            if not name or suffix == ".rs" and m["kind"] == "impl" and by == "function":
                continue
            kind = (m["kind"] or "function").lower()
            kind = "class" if kind in ("class", "struct", "enum", "trait", "impl") else kind if suffix in (".sql", ".pgsql") else "function"
            if by == "class" and kind != "class":
                continue
            if suffix in (".sql", ".pgsql"):
                stop = next((j + 1 for j in range(k, len(lines)) if lines[j].rstrip().endswith(";")), len(lines))
            else:
                stop = end(lines, k)
            # a chunk ends where the next one begins
            nxt = next((j for j in range(k + 1, stop) if (n := pattern.match(lines[j].lstrip())) and (n["name"] or n.groupdict().get("arrow"))), stop) if suffix in (".py", ".pyw") else stop
            content = "\n".join(lines[k:nxt])
            found.append((f"{_MARK.get(suffix, 'ts')}:{file}::{name.strip(chr(34) + '`[]')}", file, kind, name.strip('"`[]'), content[:most], k + 1, nxt))
    if not found:
        found.append((f"file:{file}", file, "file", file.rsplit("/", 1)[-1], text[:most], 1, len(lines)))
    return found


def blocks_of(file: str, text: str, least: int = 5) -> list[tuple]:
    """Blocks of one file that may be duplicates, see BLOCKS: functions, classes and definitions of ``least`` lines or more, one after another."""
    language = _LANGUAGES.get(_suffix(file), "")
    starts = _STARTS.get(language)
    lines = text.split("\n") if starts else []
    out, k = [], 0
    while k < len(lines):
        body = lines[k].lstrip()
        if not body.startswith(starts):
            k += 1
            continue
        depth, j = len(lines[k]) - len(body), k + 1
        if language in ("python", "bash"):
            while j < len(lines):
                s = lines[j].strip()
                if s and len(lines[j]) - len(lines[j].lstrip()) <= depth and not s.startswith(("#", "//")):
                    break
                j += 1
        else:
            level = lines[k].count("{") - lines[k].count("}")
            while j < len(lines) and level > 0:
                level += lines[j].count("{") - lines[j].count("}")
                j += 1
            j = min(j + 1, len(lines)) if j < len(lines) else j
        if j - k >= least:
            out.append((file, k + 1, j, "\n".join(lines[k:j])))
        k = j
    return out


def _exploded(files: DataFrame, make, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int32() if c.endswith(" int") else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if f and t for r in make(f, t)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    return files.select("file", "text").mapInArrow(run, schema)


def chunks(files: DataFrame, by: str = "function", most: int | None = None) -> DataFrame:
    """Chunks of all files (file, text) with their snippet, content hash, key and whether they are trivial."""
    c = _exploded(files, lambda f, t: chunks_of(f, t, by, most), CHUNKS)
    return c.withColumns({"snippet": snippet(F.col("content")), "content_hash": short_hash(F.col("content")), "key": chunk_key(F.col("file"), F.col("line_start"), F.col("line_end")), "trivial": is_trivial(F.col("file"), F.col("content"))})


def blocks(files: DataFrame, least: int = 5) -> DataFrame:
    """Blocks of all files (file, text)."""
    return _exploded(files, lambda f, t: blocks_of(f, t, least), BLOCKS)


def code_lines(text: Column) -> Column:
    """How many lines hold code: not blank, no comment, import, bare export or docstring mark."""
    skip = r"^\s*($|#|//|/\*|\*|import |from |require\(|export \{|export default\s*$|\"\"\"|''')"
    return F.size(F.filter(F.split(text, "\n"), lambda l: ~l.rlike(skip)))


def is_trivial(file: Column, text: Column) -> Column:
    """Chunks that say too little to be search results: fewer than CODE_LINES lines of code, or MARKER_LINES in a package marker, which these include."""
    n = code_lines(text)
    return (n < CODE_LINES) | (file.endswith("__init__.py") & (n < MARKER_LINES))


def snippet(text: Column) -> Column:
    """The first SNIPPET_LINES lines from the first that isn't blank; if they take more than SNIPPET_CHARS, as many whole lines as fit, and dots."""
    lines = F.split(F.regexp_replace(text, r"^(\s*\n)+", ""), "\n")
    head = F.array_join(F.slice(lines, 1, SNIPPET_LINES), "\n")
    cut = F.substring(head, 1, SNIPPET_CHARS)
    return F.when(F.length(head) <= SNIPPET_CHARS, head).otherwise(F.concat(F.when(F.contains(cut, F.lit("\n")), F.regexp_extract(cut, r"(?s)^(.*)\n", 1)).otherwise(cut), F.lit("...")))


def short_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_key(file: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", file, F.coalesce(start.cast("string"), F.lit("")), F.coalesce(end.cast("string"), F.lit("")))


def clean_sql_string(text: Column) -> Column:
    """The value of a SQL literal: outer quotes off, doubled ones single; dollar-quoted bodies are code and give nothing."""
    t = F.trim(text)
    inner = F.regexp_replace(F.regexp_extract(t, r"(?s)^[EeNn]?'(.*)'$", 1), "''", "'")
    return F.when(t.rlike(r"(?s)^\$(\w*)\$.*\$\1\$$"), "").when(t.rlike(r"(?s)^[EeNn]?'.*'$"), inner).otherwise(t)


def clean_rust_string(text: Column) -> Column:
    """The value of a Rust literal: prefix, hashes and quotes off; escapes are undone unless it is raw."""
    t = F.trim(text)
    raw = F.regexp_extract(t, r"(?s)^b?r(#*)\"(.*)\"\1$", 2)
    plain = F.regexp_extract(t, r"(?s)^[bc]?\"(.*)\"$", 1)
    for seq, value in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\r", "\r"), (r'\\"', '"')):
        plain = F.regexp_replace(plain, r"(?<!\\)" + seq, value)
    plain = F.regexp_replace(plain, r"\\\\", r"\\")
    return F.when(t.rlike(r"(?s)^b?r#*\".*\"#*$"), raw).when(t.rlike(r"(?s)^[bc]?\".*\"$"), plain).otherwise(t)


def format_size(size: Column) -> Column:
    """Bytes for people: B, KB, MB, GB, in powers of 1024; halves go to the even digit."""
    n = size.cast("double")
    some = lambda digits, unit, k: F.format_string(f"%.{digits}f {unit}", F.bround(n / k, digits))
    return F.when(n < 1024, F.format_string("%d B", size)).when(n < 1024**2, some(1, "KB", 1024)).when(n < 1024**3, some(1, "MB", 1024**2)).otherwise(some(2, "GB", 1024**3))


def path_of_uri(uri: Column) -> Column:
    """The path of a ``file:`` URI, percent-decoded (a plus stays one); anything else as it is."""
    path = F.regexp_replace(uri, r"^file:(//[^/]*)?", "")
    return F.when(uri.rlike("^file:"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(uri)
