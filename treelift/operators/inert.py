"""Text that a program never runs: comments, literals, quoted blocks and samples; and the paths among the literals.

A scanner gives the inert spans of a file, cut at line ends and every :data:`SPAN` characters.  Whether a symbol lies in one is an interval
anti-join: symbols and spans meet by file, line and stretch of the line, and one sweep in order of their places tells which symbols are
covered.  No stretch holds more than a few thousand of either, whatever the size of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, bounded, is_host_reference, is_local_reference, parent, unquote_fully

SPAN = 4096
LITERALS = 4096
#: Suffixes by language, names of fenced blocks by language, suffixes of samples, and of other programs; folders that a path can start with.
JAVASCRIPT = ["cjs", "cts", "js", "jsx", "mjs", "mts", "ts", "tsx"]
SHELL = ["bash", "sh", "zsh"]
SAMPLES = ["golden", "snap", "snapshot", "txt"]
OTHER_PROGRAMS = ["bat", "c", "cc", "cmd", "cpp", "cs", "cxx", "fish", "go", "h", "hpp", "java", "kt", "kts", "lua", "php", "pl", "ps1", "rb", "rs", "swift"]
BLOCKS = {
    "python": ["py", "python"],
    "javascript": ["javascript", "js", "jsx", "node", "ts", "tsx", "typescript"],
    "shell": ["bash", "sh", "shell", "zsh"],
}
PATH_FOLDERS = ["asset", "assets", "file", "files", "prompt", "prompts", "reference", "references", "resource", "resources", "script", "scripts"]

#: (kind, start, end): inert; quoted (in which a shell still puts variables); literal (a string's text, without its quotes).
Span = tuple[str, int, int]

_PYTHON = re.compile(r"#[^\n]*|(?i:\b([rbuf]{1,2}))?('''|\"\"\"|'|\")")
_JAVASCRIPT = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|[`'\"]|/", re.S)
_SHELL = re.compile(r"\\.|'[^']*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|(?<!\S)#[^\n]*|<<<|<<(-?)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|([^\s;&|<>()'\"]+))", re.S)
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\n]|\breturn|\btypeof|\bcase)\s*\Z")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([\w+-]*)[^\n]*$", re.M)


def _closed(text: str, at: int, quote: str, raw: bool = False) -> int:
    """Where a string's closing quote starts; an open one ends with its line, or with the text if its quotes may hold lines."""
    k = at
    while k < len(text):
        if text[k] == "\\" and not raw:
            k += 2
        elif text.startswith(quote, k):
            return k
        elif text[k] == "\n" and len(quote) == 1 and quote != "`":
            return k
        else:
            k += 1
    return len(text)


def _outside_braces(text: str, start: int, end: int, opening: str) -> Iterator[tuple[int, int]]:
    """Parts of a formatted string that are text: what stands in braces runs."""
    at = k = start
    while k < end:
        if opening == "{" and text.startswith("{{", k):
            k += 2
        elif text.startswith(opening, k):
            yield at, k
            depth, k = 1, k + len(opening)
            while k < end and depth:
                depth += {"{": 1, "}": -1}.get(text[k], 0)
                k += 1
            at = k
        else:
            k += 1
    yield at, end


def python_spans(text: str) -> Iterator[Span]:
    at = 0
    while m := _PYTHON.search(text, at):
        if m[2] is None:
            yield "inert", m.start(), m.end()
            at = m.end()
            continue
        end = _closed(text, m.end(), m[2])
        at = min(len(text), end + len(m[2]))
        if "f" in (m[1] or "").lower():
            yield from (("inert", a, b) for a, b in _outside_braces(text, m.end(), end, "{"))
        else:
            yield "inert", m.start(), at
            yield "literal", m.end(), end


def javascript_spans(text: str) -> Iterator[Span]:
    at = 0
    while m := _JAVASCRIPT.search(text, at):
        mark = m[0]
        if len(mark) > 1:
            yield "inert", m.start(), m.end()
            at = m.end()
        elif mark == "/":
            line = text.find("\n", m.end())
            end = _closed(text, m.end(), "/")
            at = m.end()
            if _BEFORE_PATTERN.search(text, max(0, m.start() - 80), m.start()) and end < (line if line >= 0 else len(text)):
                yield "inert", m.start(), end + 1
                at = end + 1
        else:
            end = _closed(text, m.end(), mark)
            at = min(len(text), end + 1)
            if mark == "`":
                yield from (("inert", a, b) for a, b in _outside_braces(text, m.end(), end, "${"))
            else:
                yield "inert", m.start(), at
                yield "literal", m.end(), end


def shell_spans(text: str) -> Iterator[Span]:
    waiting: list[tuple[str, bool, bool]] = []
    at = 0
    while m := _SHELL.search(text, at):
        line = text.find("\n", at)
        if waiting and 0 <= line < m.start():
            for a, b in _documents(text, line + 1, waiting):
                yield "inert", a, b
                line = b - 1
            waiting, at = [], line + 1
            continue
        at = m.end()
        first = m[0][0]
        if first == "'":
            yield "inert", m.start(), m.end()
            yield "literal", m.start() + 1, m.end() - 1
        elif first == '"':
            yield "quoted", m.start(), m.end()
            yield "literal", m.start() + 1, m.end() - 1
        elif first == "#":
            if not (m.start() == 0 and m[0].startswith("#!")):
                yield "inert", m.start(), m.end()
        elif name := m[2] or m[3] or m[4]:
            waiting.append((name, bool(m[1]), m[4] is not None))
    line = text.find("\n", at)
    if waiting and line >= 0:
        for a, b in _documents(text, line + 1, waiting):
            yield "inert", a, b


def _documents(text: str, at: int, waiting: list[tuple[str, bool, bool]]) -> Iterator[tuple[int, int]]:
    """Inert parts of here-documents that start at a line: all of a quoted one, else the line that ends it; the last part ends where they do."""
    for name, tabs, runs in waiting:
        start = at
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end + 1
            line = text[at:end].rstrip("\r\n")
            if (line.lstrip("\t") if tabs else line) == name:
                yield (at if runs else start), end
                at = end
                break
            at = end
        else:
            yield (len(text) if runs else start), len(text)


def markdown_spans(text: str) -> Iterator[Span]:
    at = 0
    while m := _FENCE.search(text, at):
        body = min(len(text), m.end() + 1)
        close = re.compile(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", re.M).search(text, body)
        end, at = (close.start(), close.end()) if close else (len(text), len(text))
        language = next((k for k, names in BLOCKS.items() if m[2].lower() in names), None)
        if language is None:
            yield "inert", m.start(), at
        else:
            yield from ((kind, body + a, body + b) for kind, a, b in SCANNERS[language](text[body:end]) if kind != "literal")
        if at <= m.start():
            return


SCANNERS = {"python": python_spans, "javascript": javascript_spans, "shell": shell_spans, "markdown": markdown_spans}


def language(path: Column, content: Column, executable: Column) -> Column:
    """By which rules a file is read: python, javascript, shell, markdown, sample (all of it inert), other (a program of another language) or null."""
    suffix = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    first = F.lower(F.when(F.startswith(content, F.lit("#!")), F.regexp_extract(content, r"\A([^\n]*)", 1)))
    return (
        F.when(suffix.isin("md", "markdown"), "markdown")
        .when((suffix == "py") | F.contains(first, F.lit("python")), "python")
        .when(suffix.isin(JAVASCRIPT) | first.rlike("bun|deno|node"), "javascript")
        .when(suffix.isin(SAMPLES), "sample")
        .when(suffix.isin(SHELL) | first.isNotNull(), "shell")
        .when(suffix.isin(OTHER_PROGRAMS), "other")
        .when(executable, "shell")
    )


def _cut(text: str, spans: Iterator[Span]) -> Iterator[tuple[int, int, int, str]]:
    """Inert and quoted spans by line (from 1) and place in it (from 0), in stretches of SPAN characters."""
    line, start = 1, 0
    for kind, a, b in sorted((s for s in spans if s[0] != "literal" and s[2] > s[1]), key=lambda s: s[1]):
        while (end := text.find("\n", start)) >= 0 and end < a:
            line, start = line + 1, end + 1
        at, here, base = a, line, start
        while at < b:
            end = text.find("\n", base)
            end = len(text) if end < 0 else end
            while at < min(b, end):
                upto = min(b, end, base + ((at - base) // SPAN + 1) * SPAN)
                yield here, at - base, upto - base, kind
                at = upto
            at = max(at, end + 1)
            here, base = here + 1, end + 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for source, path, how, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows = list(_cut(text, SCANNERS[how](text)))
            if rows:
                line, a, b, kind = zip(*rows, strict=True)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([source] * n), pa.array([path] * n), pa.array(line, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind)], ["source_id", "path", "line", "start", "end", "kind"])


def _texts(inventory: DataFrame) -> DataFrame:
    rows = inventory.where((F.col("kind") == "file") & F.col("content").isNotNull())
    return rows.select("source_id", "path", language(F.col("path"), F.col("content"), F.col("executable")).alias("how"), "content")


def inert_spans(inventory: DataFrame, of: DataFrame) -> DataFrame:
    """source_id, path, line, start, end, kind of the spans in files (source_id, path) of ``of``."""
    wanted = _texts(inventory).join(of.select("source_id", "path").distinct(), ["source_id", "path"], "left_semi")
    return wanted.where(F.col("how").isin(list(SCANNERS))).mapInArrow(_spans, "source_id string, path string, line int, start int, end int, kind string")


def covered(points: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """Points (key, at, ...) that lie in a span (key, start, end) of their key: spans hold their start and not their end.

    Both are put in order of place, spans first; a point is covered if some span that starts no later ends behind it. A window holds what has one
    key and lies within SPAN places, so spans must not cross a multiple of SPAN.
    """
    by = [*key, "stretch"]
    events = spans.select(*key, F.col("start").alias("place"), F.col("end"), F.lit(0).alias("turn"), F.lit(None).alias("point"))
    given = points.select(*key, F.col("at").alias("place"), F.lit(None).cast("int").alias("end"), F.lit(1).alias("turn"), F.struct(*points.columns).alias("point"))
    both = events.withColumn("point", F.lit(None).cast(given.schema["point"].dataType)).unionByName(given)
    both = both.withColumn("stretch", F.floor(F.col("place") / SPAN))
    before = Window.partitionBy(*by).orderBy("place", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("reach", F.max("end").over(before))
    return swept.where((F.col("turn") == 1) & (F.col("reach") > F.col("place"))).select("point.*")


def active_references(refs: DataFrame, inventory: DataFrame) -> DataFrame:
    """References without the symbols (those with a column) that stand in inert text; variables count in a shell's double quotes."""
    symbols = refs.where("col is not null")
    texts = _texts(inventory).select("source_id", "path", (F.col("how") == "sample").alias("sample"))
    placed = symbols.join(texts, ["source_id", "path"])
    spans = inert_spans(inventory, symbols)
    key = ["source_id", "path", "line"]
    point = placed.where("not sample or sample is null").select(*key, F.col("col").alias("at"), "ord", "syntax")
    hard = covered(point, spans.where("kind = 'inert'"), key)
    soft = covered(point.where("syntax <> 'plugin.variable'"), spans.where("kind = 'quoted'"), key)
    sampled = placed.where("sample").select(*key, F.col("col").alias("at"), "ord", "syntax")
    out = hard.unionByName(soft).unionByName(sampled).select(*key, "ord", "syntax").distinct()
    return refs.join(out, [*key, "ord", "syntax"], "left_anti")


def _literal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["source_id", "path", "line", "ord", "syntax", "value"]
    for batch in batches:
        for source, path, how, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = SCANNERS.get(how, javascript_spans)(text)
            rows, line, start = [], 1, 0
            for n, (a, b) in enumerate((a, b) for kind, a, b in spans if kind == "literal" and 0 < b - a <= 2048):
                line, start = line + text.count("\n", start, a), a
                if n == LITERALS:
                    rows.append((source, path, line, n, "residual.limit", f"literal limit {LITERALS} exceeded"))
                    break
                if _looks_like_a_path(text[a:b]):
                    rows.append((source, path, line, n, "residual.literal", text[a:b]))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _looks_like_a_path(value: str) -> bool:
    """Whether a literal can be the path of a file: one that says so, has a suffix, climbs, or starts in a folder that usually holds files."""
    if "\n" in value or " " in value.strip() or not value.strip():
        return False
    parts = value.replace("\\", "/").split("/")
    suffix = re.search(r"[^./]\.[^./]+$", parts[-1])
    return value.startswith(("./", "../", "$", "%")) or ".." in parts or bool(suffix) or re.sub(r"[\W_]", "", parts[0].lower()) in PATH_FOLDERS


def residual_literals(inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, path, line, ord, syntax, value: literals that may be paths, in the programs of candidates: files of a program's suffix, that may be run, or that name their interpreter."""
    roots = candidates.select("source_id", "root")
    texts = _texts(inventory).where(F.col("how").isin("python", "javascript", "shell", "other"))
    own = texts.select("source_id", "path", F.explode(ancestors(parent(F.col("path")))).alias("root")).join(roots, ["source_id", "root"])
    programs = texts.join(own.select("source_id", "path").distinct(), ["source_id", "path"], "left_semi")
    return programs.mapInArrow(_literal_rows, "source_id string, path string, line int, ord int, syntax string, value string")


def residual_evidence(literals: DataFrame, resolved: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, root, code, path, line, ord, value: STATIC_ANALYSIS_INCOMPLETE for literals that name a file outside their candidate, or leave the tree.

    resolved: the literals with root, target and outcome, as :func:`treelift.operators.references.resolve` gives them.
    """
    decoded = unquote_fully(F.col("value"))
    local = is_local_reference(decoded) & ~is_host_reference(decoded)
    shown = F.concat("value", F.lit(" -> "), F.when(F.col("outcome") == "outside", F.col("target")).otherwise("<outside snapshot>"))
    paths = resolved.where(F.col("outcome").isin("outside", "escape") & local).withColumn("value", bounded(shown))
    limits = literals.where("syntax = 'residual.limit'").withColumn("root", F.explode(ancestors(parent(F.col("path"))))).join(candidates.select("source_id", "root"), ["source_id", "root"])
    columns = ["source_id", "root", "path", "line", "ord", "value"]
    found = paths.select(*columns).unionByName(limits.select(*columns))
    return found.withColumn("code", F.lit("STATIC_ANALYSIS_INCOMPLETE")).select("source_id", "root", "code", "path", "line", "ord", "value")
