"""An inventory of source trees made from the documents table.

Every language is a source and every document a candidate directory with an entrypoint; packages get a manifest
(with a runtime key, a tool server and a program that calls one candidate for half of them), a command and a shared file; some documents
get a guide file, links that loop, dangle, leave the tree or the candidate, run through linked folders or close a cycle of folders, files that
differ in case only, a second entrypoint, or a package of their own inside; and a chain of symbolic links runs over all of them.

The rows of a document, and those of a package, are lists of (condition, path, link target, content) in SQL that Spark and DuckDB share: Spark
makes them in one pass over the texts, DuckDB by a union.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treelift.sources.tables import table

_ROOT = "'packages/', source, '/d', doc_id, '/"
_SKILL = """concat('---', {nl}, 'name: ', CASE WHEN doc_id % 17 = 0 THEN '' ELSE {name} END, {nl}, 'description: ', lang, {nl}, '---', {nl}, t, {nl},
  '[guide](', CASE doc_id % 7 WHEN 0 THEN 'references/guide.md' WHEN 1 THEN '../shared/common.md' WHEN 2 THEN 'missing.md'
    WHEN 3 THEN '%2e%2e/%2e%2e/%2e%2e/%2e%2e/up.md' WHEN 4 THEN 'https://example.org/x' WHEN 5 THEN '/etc/hosts' ELSE '#top' END, ')',
  CASE WHEN doc_id % 11 = 0 THEN concat({nl}, 'run $', '{{PLUGIN_ROOT}}/tool') ELSE '' END,
  CASE WHEN doc_id % 43 = 5 THEN concat({nl}, 'ask mcp__', source, '__find') ELSE '' END,
  CASE WHEN doc_id % 47 = 6 THEN concat({nl}, 'then /deploy it') ELSE '' END,
  CASE WHEN doc_id % 19 = 5 THEN concat({nl}, '```text', {nl}, 'ask mcp__', source, '__find', {nl}, 'then /deploy it', {nl}, '```') ELSE '' END)"""


def _file(condition: str, path: str, content: str) -> tuple[str, str, str, str]:
    return (condition, f"concat({path})", "NULL", content)


def _link(condition: str, path: str, target: str) -> tuple[str, str, str, str]:
    return (condition, f"concat({path})", target, "NULL")


DOCUMENT_ROWS = [
    _file("true", f"{_ROOT}SKILL.md'", _SKILL),
    _file("doc_id % 29 = 1", f"{_ROOT}skill.md'", "'second'"),
    _file("doc_id % 53 = 7", f"{_ROOT}inner/plugin.json'", """'{{"name": "inner", "runtime": "x"}}'"""),
    _file("doc_id % 59 = 8", f"{_ROOT}Notes.txt'", "'a'"),
    _file("doc_id % 59 = 8", f"{_ROOT}notes.txt'", "'b'"),
    _file("doc_id % 7 = 0", f"{_ROOT}references/guide.md'", "concat('guide ', doc_id)"),
    _file("doc_id % 23 = 15", f"{_ROOT}tool.py'", """concat('# mcp__', source, '__find in "../shared/common.md"', {nl}, 'x = open("../shared/common.md", "r")', {nl}, 'y = "mcp__', source, '__find own.txt"')"""),
    _file("doc_id % 23 = 16", f"{_ROOT}tool.sh'", """concat('echo ', {nl}, 'cat ', chr(39), '../shared/common.md', chr(39), ' "$', '{{PLUGIN_ROOT}}/x" # $', '{{PLUGIN_ROOT}}')"""),
    _link("doc_id % 31 = 2", f"{_ROOT}loop'", "'loop'"),
    _link("doc_id % 37 = 3", f"{_ROOT}out'", "'../../../../outside'"),
    _link("doc_id % 41 = 4", f"{_ROOT}ghost'", "'nothing'"),
    _file("doc_id % 61 = 9", f"{_ROOT}real/x.txt'", "'x'"),
    _link("doc_id % 61 = 9", f"{_ROOT}via'", "'real'"),
    _link("doc_id % 61 = 9", f"{_ROOT}alias'", "'via/x.txt'"),
    _link("doc_id % 61 = 9", f"{_ROOT}lost'", "'via/y.txt'"),
    _link("doc_id % 61 = 10", f"{_ROOT}deep/up'", "'..'"),
    _link("doc_id % 67 = 11", f"{_ROOT}left/to'", "'../right'"),
    _link("doc_id % 67 = 11", f"{_ROOT}right/to'", "'../left'"),
    _link("doc_id % 67 = 11", f"{_ROOT}right/over'", "'to/to/to'"),
    _link("doc_id % 71 = 12", f"{_ROOT}ring'", "'ring2'"),
    _link("doc_id % 71 = 12", f"{_ROOT}ring2'", "'ring'"),
    _link("doc_id % 73 = 13", f"{_ROOT}shared'", "'../shared'"),
    _link("doc_id % 73 = 13", f"{_ROOT}common'", "'shared/common.md'"),
    _link("doc_id % 79 = 14", f"{_ROOT}host'", "'/etc/hosts'"),
    _file("doc_id % 4 = 3", "'links/d', doc_id", "'end'"),
    _link("doc_id % 4 <> 3", "'links/d', doc_id", "concat('d', CAST(floor(doc_id / 3) AS BIGINT))"),
]
PACKAGE_ROWS = [
    _file("length(source) % 2 = 0", "'packages/', source, '/commands/deploy.md'", "'deploys'"),
    _file("true", "'packages/', source, '/plugin.json'", """CASE WHEN length(source) % 2 = 0
      THEN concat('{{"name": "', source, '", "runtime": "src/main.py", "mcpServers": {{"', source, '": {{}}}}}}') ELSE concat('{{"name": "', source, '"}}') END"""),
    _file("length(source) % 2 = 0 OR length(source) = 5", "'packages/', source, '/shared/common.md'", "'shared'"),
    _file("length(source) % 2 = 0", "'packages/', source, '/src/main.py'", """concat('runSkill("d', first, '")')"""),
]

#: Configuration of programs, with patterns over the tree; kept apart from the rows that every query reads.
CONFIG_ROWS = [
    _file("doc_id % 13 = 4", f"{_ROOT}lib/tsconfig.json'", """concat('{{"extends": "../../shared/common.md",', {nl}, '"include": ["**/*.ts", "[!b-z]?.ts", "refer*/*.md", "../../shared/*.md",', {nl},
      '"none/*.x", "%252e%252e/*"],', {nl}, '"files": ["n', doc_id, '.ts"], "path": 5, "references": [{{"path": "p', doc_id, '"}}]}}')"""),
    _file("doc_id % 13 = 4", f"{_ROOT}lib/a', doc_id % 10, '.ts'", "'a'"),
    _file("doc_id % 26 = 4", f"{_ROOT}lib/sub/z', doc_id, '.ts'", "'z'"),
    _file("doc_id % 13 = 4", f"{_ROOT}lib/sub/deep/y.ts'", "'y'"),
    _file("doc_id % 39 = 4", f"{_ROOT}references/note.md'", "'n'"),
    _file("doc_id % 13 = 5", f"{_ROOT}package.json'", """concat('{{"main": ', doc_id)"""),
    _file("doc_id % 13 = 6", f"{_ROOT}settings.json'", """concat('{{"script": ["run', doc_id, '.sh", 5, "', lang, '"]}}')"""),
]


def _union(rows: list[tuple[str, str, str, str]], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT lang AS source_id, {path} AS path, '{'file' if target == 'NULL' else 'symlink'}' AS kind, false AS executable, "
        f"CAST({target} AS VARCHAR) AS symlink_target, CAST({content} AS VARCHAR) AS content FROM {source} WHERE {condition}"
        for condition, path, target, content in rows
    )


def _inline(rows: list[tuple[str, str, str, str]], source: str) -> str:
    made = ", ".join(
        f"CASE WHEN {condition} THEN named_struct('path', {path}, 'kind', '{'file' if target == 'NULL' else 'symlink'}', 'executable', false, "
        f"'symlink_target', CAST({target} AS STRING), 'content', CAST({content} AS STRING)) END"
        for condition, path, target, content in rows
    )
    return f"SELECT lang AS source_id, inline(array_compact(array({made}))) FROM {source}"


_DOCS = "SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, coalesce(text, '') AS t FROM documents"
_PACKAGES = "SELECT lang, source, min(doc_id) AS first FROM {docs} GROUP BY lang, source"

def _duckdb(of_documents: list[tuple[str, str, str, str]]) -> str:
    rows = _union(of_documents, "d") + " UNION ALL " + _union(PACKAGE_ROWS, "pk")
    return (
        f"d AS ({_DOCS}), pk AS ({_PACKAGES.format(docs='d')}), raw AS ("
        + rows.format(nl="chr(10)", name="regexp_replace(split_part(t, ' ', 1), '[^A-Za-z]', '', 'g')")
        + "), inventory AS (SELECT *, CASE WHEN kind = 'file' THEN sha256(content) END AS sha256, "
        "CAST(CASE WHEN kind = 'file' THEN strlen(content) ELSE strlen(symlink_target) END AS BIGINT) AS size FROM raw)"
    )


DUCKDB_INVENTORY = _duckdb(DOCUMENT_ROWS)
DUCKDB_CONFIGURED = _duckdb(DOCUMENT_ROWS + CONFIG_ROWS)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, path, kind, symlink_target of the inventory, without reading a text."""
    rows = [[(c, p, t, "NULL") for c, p, t, _ in made] for made in (DOCUMENT_ROWS, PACKAGE_ROWS)]
    return _rows(spark, sf_dir, *rows).select("source_id", "path", "kind", "symlink_target")


def inventory(spark: SparkSession, sf_dir: str, configured: bool = False) -> DataFrame:
    """source_id, path, kind, executable, symlink_target, content, sha256, size; configured adds the rows of CONFIG_ROWS."""
    rows = _rows(spark, sf_dir, DOCUMENT_ROWS + CONFIG_ROWS * configured, PACKAGE_ROWS)
    size = F.when(F.col("kind") == "file", F.octet_length("content")).otherwise(F.octet_length("symlink_target"))
    return rows.withColumns({"sha256": F.when(F.col("kind") == "file", F.sha2("content", 256)), "size": size.cast("long")})


def _rows(spark: SparkSession, sf_dir: str, of_documents: list, of_packages: list) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        "doc_id",
        F.coalesce("lang", F.lit("none")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"),
        F.coalesce("text", F.lit("")).alias("t"),
    )
    view = f"docs_{uuid.uuid4().hex}"
    docs.createOrReplaceTempView(view)
    own = _inline(of_documents, view).format(nl="char(10)", name="regexp_replace(split_part(t, ' ', 1), '[^A-Za-z]', '')")
    packages = _inline(of_packages, f"({_PACKAGES.format(docs=view)})").format()
    return spark.sql(f"{own} UNION ALL {packages}")
