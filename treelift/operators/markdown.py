"""References in Markdown: links, reference definitions, frontmatter fields, shell blocks and paths to act on.

Fenced blocks, code spans and escaped brackets hold no links.  Of definitions of one label the first counts, and only if the
label is used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of frontmatter and of text configuration that hold paths, and names of shell blocks.
PATH_FIELDS = ["entrypoint", "executable", "file", "path", "runtime", "script", "source", "root"]
SHELL_BLOCKS = ["sh", "bash", "shell", "zsh", "console"]
ACTIONS = ["run", "execute", "open", "read", "load", "source"]

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})\s*([\w+-]*)")
_FIELD = re.compile(rf"\s*({'|'.join(PATH_FIELDS)})\s*[:=]\s*[\"']?([^\s#;\"']+)")
_DEFINITION = re.compile(r" {0,3}\[([^\]\\]+)\]:\s*(?:<([^>]*)>|(\S+))")
_ACTION = re.compile(rf"(?i)\b(?:{'|'.join(ACTIONS)})\s+((?:\.{{1,2}}/|[\w-]+/)[\w./-]*\w)")
_TOKEN = re.compile(r"[^\s;|&<>\"'()]+")

Row = tuple[int, str, str]


def _without_code(line: str) -> str:
    """The line with code spans blanked: a run of backticks up to the next run of the same length."""
    out, at = line, 0
    runs = [(m.start(), m.end()) for m in re.finditer("`+", line)]
    for k, (a, b) in enumerate(runs):
        if a < at or (a and line[a - 1] == "\\"):
            continue
        close = next(((c, d) for c, d in runs[k + 1 :] if d - c == b - a), None)
        if close:
            out = out[:a] + " " * (close[1] - a) + out[close[1] :]
            at = close[1]
    return out


def _destination(line: str, at: int) -> str | None:
    """What a link's parenthesis, opened before ``at``, leads to."""
    while at < len(line) and line[at] in " \t":
        at += 1
    if line[at : at + 1] == "<":
        end = line.find(">", at)
        return line[at + 1 : end] if end > 0 else None
    depth, start = 0, at
    while at < len(line) and not line[at].isspace():
        if line[at] == "(":
            depth += 1
        elif line[at] == ")":
            if not depth:
                break
            depth -= 1
        at += 1
    return line[start:at] if at < len(line) and at > start else None


def _brackets(line: str) -> Iterator[tuple[str, int]]:
    """Texts in brackets, with the place after each; escaped brackets are text."""
    open_at: list[int] = []
    k = 0
    while k < len(line):
        if line[k] == "\\":
            k += 1
        elif line[k] == "[":
            open_at.append(k)
        elif line[k] == "]" and open_at:
            yield line[open_at.pop() + 1 : k], k + 1
        k += 1


def markdown_rows(text: str) -> list[Row]:
    """(line, syntax, value) of a file's references, in order of lines."""
    lines = text.split("\n")
    rows: list[Row] = []
    definitions: dict[str, tuple[int, str]] = {}
    used: set[str] = set()
    start = 0
    if lines[0] == "---" and "---" in lines[1:]:
        start = lines.index("---", 1) + 1
        for k in range(1, start - 1):
            if m := _FIELD.match(lines[k]):
                rows.append((k + 1, "markdown.frontmatter", m[2]))
    fence, language = "", ""
    for k in range(start, len(lines)):
        line, number = lines[k], k + 1
        mark = _FENCE.match(line) if "```" in line or "~~~" in line else None
        if fence:
            if mark and mark[1].startswith(fence) and not mark[2]:
                fence = ""
            elif language in SHELL_BLOCKS:
                rows += [(number, "shell.command", t) for t in _shell_paths(line)]
            continue
        if mark:
            fence, language = mark[1], mark[2].lower()
            continue
        if "[" not in line and "/" not in line:
            continue
        plain = _without_code(line) if "`" in line else line
        if m := _DEFINITION.match(plain):
            definitions.setdefault(m[1].casefold(), (number, m[2] or m[3]))
            continue
        for label, after in _brackets(plain):
            following = plain[after : after + 1]
            if following == "(":
                if value := _destination(plain, after + 1):
                    rows.append((number, "markdown.link", value))
                continue
            if following == "[" and (end := plain.find("]", after)) > after + 1:
                label = plain[after + 1 : end]
            used.add(label.casefold())
        rows += [(number, "markdown.action_path", m[1]) for m in _ACTION.finditer(plain)]
    rows += [(number, "markdown.reference", value) for label, (number, value) in definitions.items() if label in used]
    return sorted(rows, key=lambda r: r[0])


def _shell_paths(line: str) -> list[str]:
    """Relative paths among the words of a command line."""
    words = _TOKEN.findall(line.strip().removeprefix("$ "))
    return [w for w in words if "/" in w and not w.startswith(("-", "/")) and "://" not in w and "=" not in w]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, line, order, syntax, value = [], [], [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            for n, (number, name, found) in enumerate(markdown_rows(text)):
                owner.append(k)
                line.append(number)
                order.append(n)
                syntax.append(name)
                value.append(found)
        at = pa.array(owner, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(order, pa.int32()), pa.array(syntax, pa.string()), pa.array(value, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["source_id", "path", "line", "ord", "syntax", "value"])


def markdown_references(inventory: DataFrame) -> DataFrame:
    """source_id, path, line, ord, syntax, value of all Markdown files; files without text have none."""
    files = inventory.where((F.col("kind") == "file") & F.col("content").isNotNull() & F.lower("path").rlike(r"\.(?:md|markdown)$"))
    return files.select("source_id", "path", "content").mapInArrow(_rows, "source_id string, path string, line int, ord int, syntax string, value string")
