"""References, symbols and frontmatter in text files, and where references lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, collapse, is_host_reference, is_local_reference, is_within, parent, unquote, unquote_fully
from treelift.operators.markdown import PATH_FIELDS, markdown_references

#: Names of the environment variables that hold a plugin's root, and commands of the host.
_ROOT_NAME = r"(?:(?:CLAUDE_|CODEX_|CURSOR_|GEMINI_|OPENCLAW_)?PLUGIN_(?:ROOT|DIR|PATH)|EXTENSION_(?:ROOT|DIR|PATH))"
PLUGIN_VARIABLE = rf"(?i)\$\{{(?:env:|[#!])?{_ROOT_NAME}(?![A-Za-z0-9_])[^}}\r\n]{{0,256}}\}}|\$(?:env:)?{_ROOT_NAME}(?![A-Za-z0-9_])|%{_ROOT_NAME}%|(?<![A-Za-z0-9_])extensionPath(?![A-Za-z0-9_])"
MCP_TOOL = r"(?<![A-Za-z0-9_])mcp__[A-Za-z0-9_.-]+__[A-Za-z0-9_.-]+"
COMMAND = r"(?:^|\s)(/[A-Za-z0-9_.-]*[A-Za-z0-9_-])(?=$|[\s.,;:!?)])"
CONFIG_FIELD = rf"^\s*({'|'.join(PATH_FIELDS)})\s*[:=]\s*[\"']?([^\s#;\"']+)"
CONFIG_FILES = r"(?i)\.(?:cfg|ini|toml|yaml|yml)$"
#: Calls by which a program runs a skill, and how a configuration names one or several.
SKILL_CALL = r"(?<![A-Za-z0-9_])(?:runSkill|loadSkill|load_skill|invokeSkill|invoke_skill|skills?\.get)\s*\(\s*[\"']([^\"']+)[\"']"
SKILL_KEY = r"^\s*[\"']?skill[\"']?\s*:\s*[\"']?([A-Za-z0-9_./-]+)"
SKILL_LIST = r"^\s*[\"']?skills[\"']?\s*:\s*\[([^\]]*)\]"
SKILL_PATH = r"([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*)/(?:SKILL|skill)\.md"
#: Suffixes of files that a package may run.
LIST_ITEMS = 64
RUNTIME_SUFFIXES = r"(?i)\.(?:py|js|ts|mjs|cjs|mts|cts|sh|bash|zsh|rb|go|rs|java|kt|php|pl|ps1|lua)$"
#: A value that is only known when it runs: variables, placeholders in braces, and wildcards.
DYNAMIC = r"[*?]|\{[^}]+\}|\$[A-Za-z_{]"


def lines_of(inventory: DataFrame) -> DataFrame:
    """source_id, path, line (from 1) and its text, of all files that are text."""
    rows = inventory.where((F.col("kind") == "file") & F.col("content").isNotNull())
    return rows.select("source_id", "path", F.posexplode(F.split("content", "\n")).alias("at", "text")).select(
        "source_id", "path", (F.col("at") + 1).alias("line"), "text"
    )


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), F.lit(group))


def _structs(syntax: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(syntax).alias("syntax"), v.alias("value"), F.lit(None).cast("int").alias("col")))


def _placed(syntax: str, pattern: str, group: int) -> Column:
    """Matches with the place in the line (from 0) where each starts: behind all that lies between matches, and all matches before it."""
    found, between = _all(pattern, 0), F.split("text", pattern)
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part))
    values = _all(pattern, group) if group else found

    def row(value: Column, k: Column) -> Column:
        start = length(F.slice(between, 1, k + 1)) + length(F.slice(found, 1, k)) + F.length(F.get(found, k)) - F.length(value)
        return F.struct(F.lit(syntax).alias("syntax"), value.alias("value"), start.alias("col"))

    return F.transform(values, row)


def may_hold_symbols(text: Column) -> Column:
    """Whether a text can hold a symbol at all: cheap, and true of every text that has one."""
    hints = [F.contains(text, F.lit(h)) for h in ("$", "%", "extensionPath", "mcp__", " /", "\n/")]
    return hints[0] | hints[1] | hints[2] | hints[3] | hints[4] | hints[5]


def with_symbols(inventory: DataFrame) -> DataFrame:
    """The files whose texts can hold a symbol."""
    return inventory.where((F.col("kind") == "file") & F.col("content").isNotNull() & may_hold_symbols(F.col("content")))


def references(inventory: DataFrame, hinted: DataFrame | None = None) -> DataFrame:
    """source_id, path, line, ord, syntax, value, col: references of Markdown and configuration files, and root variables, tools and
    commands in every text, these with their place in the line. Files and lines that can't hold a symbol are left out before any pattern runs;
    hinted are the files of :func:`with_symbols`, where they are kept."""
    texts = inventory.where((F.col("kind") == "file") & F.col("content").isNotNull())
    fields = lines_of(texts.where(F.col("path").rlike(CONFIG_FILES)))
    fields = fields.select("source_id", "path", "line", F.posexplode(_structs("config.field", _all(CONFIG_FIELD, 2))).alias("ord", "r"))

    lines = lines_of(with_symbols(inventory) if hinted is None else hinted).where(may_hold_symbols(F.concat(F.lit("\n"), "text")))
    symbols = F.concat(_placed("plugin.variable", PLUGIN_VARIABLE, 0), _placed("mcp.tool", MCP_TOOL, 0), _placed("plugin.command", COMMAND, 1))
    symbols = lines.select("source_id", "path", "line", F.posexplode(symbols).alias("ord", "r"))
    native = fields.unionByName(symbols).select("source_id", "path", "line", (F.col("ord") + 1000).alias("ord"), "r.syntax", "r.value", "r.col")
    return markdown_references(texts).unionByName(native, allowMissingColumns=True)


#: Plain YAML scalars that are no strings.
_NO_STRING = r"(?i)^(?:[-+]?[0-9][0-9_,]*(?:\.[0-9_]*)?(?:e[-+]?[0-9]+)?|0x[0-9a-f]+|[-+]?\.(?:inf|nan)|[0-9]{4}-[0-9]{2}-[0-9]{2}.*|true|false|yes|no|on|off|null|~|[\[{&*!].*)$"


def frontmatter(inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, root, valid, name, description, problem: string fields between the first two lines '---'.

    Plain, quoted and block scalars are read; a value that YAML takes for a number, a date, a truth value, a list or a mapping is no string.
    """
    entries = candidates.select("source_id", "root", F.col("entrypoint").alias("path")).join(
        inventory.select("source_id", "path", "kind", "content"), ["source_id", "path"]
    )
    whole = r"\A---\n((?s:.*?))\n---(?:\n|\z)"
    head = F.when((F.col("kind") == "file") & F.col("content").rlike(whole), F.regexp_extract("content", whole, 1))
    names = ["name", "description"]
    # each step names what the next one uses more than once, so that it is worked out once a row
    rows = entries.select("source_id", "root", head.alias("head"))
    raw = {f"{n}_raw": F.trim(F.regexp_extract("head", rf"(?m)^{n}:[ \t]*(.*)$", 1)) for n in names}
    block = {f"{n}_block": F.regexp_extract("head", rf"(?m)^{n}:[ \t]*[>|][-+]?[ \t]*((?:\n(?:[ \t]+.*)?)+)", 1) for n in names}
    rows = rows.withColumns(raw | block)
    rows = rows.withColumns({f"{n}_plain": F.trim(F.regexp_replace(f"{n}_raw", r"(?:^|\s)#.*$", "")) for n in names})

    def field(name: str) -> Column:
        raw, plain = F.col(f"{name}_raw"), F.col(f"{name}_plain")
        lines = F.trim(F.regexp_replace(f"{name}_block", r"\n[ \t]*", "\n"), F.lit("\n"))
        folded = F.when(F.startswith(raw, F.lit(">")), F.regexp_replace(lines, r"\n(?!\n)", " ")).otherwise(lines)
        quoted = raw.rlike("^(?:\"[^\"]*\"|'[^']*')(?:\\s+#.*)?$")
        return (
            F.when(raw.rlike("^[>|][-+]?$"), folded)
            .when(quoted, F.regexp_replace(raw, "^([\"'])(.*?)\\1.*$", "$2"))
            .when(~plain.rlike(_NO_STRING), plain)
        )

    rows = rows.select("source_id", "root", "head", *(field(n).alias(n) for n in names))
    rows = rows.select("source_id", "root", "head", *(F.when(F.trim(n) != "", F.col(n)).alias(n) for n in names))
    problem = F.when(F.col("head").isNull(), "frontmatter").when(F.col("name").isNull(), "name").when(F.col("description").isNull(), "description")
    rows = rows.select("source_id", "root", *names, problem.alias("problem"))
    valid = F.col("problem").isNull()
    return rows.select("source_id", "root", valid.alias("valid"), *(F.when(valid, F.col(n)).alias(n) for n in names), "problem")


def resolve(refs: DataFrame, inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """Path references of candidates' files with their candidate root, target and outcome.

    Probes are the file's directory, the candidate's root and the tree's root, the first hit wins; a reference with '..' has the
    first probe only.  outcome: host, remote, dynamic, escape, inside, outside, missing.
    """
    roots = candidates.select("source_id", "root")
    paths = refs.where(F.startswith("syntax", F.lit("markdown.")) | F.col("syntax").isin("shell.command", "config.field", "residual.literal"))
    placed = (
        paths.withColumn("root", F.explode(ancestors(parent(F.col("path")))))
        .join(roots, ["source_id", "root"])
        .withColumns({"decoded": unquote_fully(F.col("value")), "once": unquote(F.col("value"))})
    )
    up = F.col("once").rlike(r"(?:^|/)\.\.(?:/|$)")
    probes = F.when(up, F.array(collapse(parent(F.col("path")), F.col("once")))).otherwise(
        F.array(collapse(parent(F.col("path")), F.col("once")), collapse(F.col("root"), F.col("once")), collapse(F.lit("."), F.col("once")))
    )
    key = ["source_id", "path", "line", "ord", "root"]
    probed = placed.select(*key, F.posexplode(probes).alias("probe", "target"))
    hits = probed.join(inventory.select("source_id", F.col("path").alias("target")), ["source_id", "target"]).groupBy(*key).agg(F.min_by("target", "probe").alias("hit"))
    first = collapse(parent(F.col("path")), F.col("once"))
    hidden = (F.col("decoded") != F.col("once")) & F.col("decoded").rlike(r"(?:^|/)\.\.(?:/|$)")
    outcome = (
        F.when(is_host_reference(F.col("decoded")), "host")
        .when(~is_local_reference(F.col("decoded")), "remote")
        .when(F.col("decoded").rlike(DYNAMIC), "dynamic")
        .when(hidden | first.isNull(), "escape")
        .when(F.col("hit").isNull(), "missing")
        .when(is_within(F.col("hit"), F.col("root")), "inside")
        .otherwise("outside")
    )
    joined = placed.join(hits, key, "left")
    return joined.select(*key, "value", F.when(outcome.isin("inside", "outside"), F.col("hit")).when(outcome == "missing", first).alias("target"), outcome.alias("outcome"))


def reverse_references(inventory: DataFrame, candidates: DataFrame, boundaries: DataFrame, names: DataFrame) -> DataFrame:
    """source_id, root, path, line, ord, value: where a package's own program names one of the candidates in it.

    Programs lie in a mixed package but in no candidate.  A candidate goes by its name, its directory's name, and its path from the
    package or the tree; these identities are joined by equality, so programs and candidates are never paired up.
    """
    mixed = boundaries.where(F.col("package_kind") == "mixed").select("source_id", F.col("root").alias("package")).distinct()
    programs = inventory.where((F.col("kind") == "file") & F.col("path").rlike(RUNTIME_SUFFIXES)).select("source_id", "path", "kind", "content")
    above = programs.select("source_id", "path", F.explode(ancestors(F.col("path"))).alias("root"))
    own = above.join(candidates.select("source_id", "root"), ["source_id", "root"]).select("source_id", "path").distinct()
    programs = programs.join(own, ["source_id", "path"], "left_anti")
    listed = F.slice(F.transform(F.split(F.array_join(_all(SKILL_LIST, 1), ","), ","), lambda v: F.regexp_replace(F.trim(v), "^[\"']|[\"']$", "")), 1, LIST_ITEMS)
    named = (
        lines_of(programs)
        .select("source_id", "path", "line", F.posexplode(F.concat(_all(SKILL_CALL, 1), _all(SKILL_PATH, 1), _all(SKILL_KEY, 1), listed)).alias("ord", "value"))
        .withColumn("package", F.explode(ancestors(F.col("path"))))
        .join(mixed, ["source_id", "package"])
    )
    inside = candidates.where("boundary_root is not null").join(names.select("source_id", "root", "name"), ["source_id", "root"], "left")
    relative = F.when(F.col("boundary_root") == ".", F.col("root")).otherwise(F.substr("root", F.length("boundary_root") + 2))
    identities = F.array_compact(F.array_distinct(F.array("name", F.element_at(F.split("root", "/"), -1), relative, F.col("root"))))
    known = inside.select("source_id", "root", F.col("boundary_root").alias("package"), F.explode(identities).alias("value"))
    return named.join(known, ["source_id", "package", "value"]).select("source_id", "root", "path", "line", "ord", "value")


def owned_symbols(inventory: DataFrame, boundaries: DataFrame) -> DataFrame:
    """source_id, package, kind, symbol (in lower case): tools and commands that packages declare or hold by convention."""
    declared = inventory.select("source_id", F.col("path").alias("manifest_path"), "content").join(
        boundaries.select("source_id", F.col("root").alias("package"), "manifest_path"), ["source_id", "manifest_path"]
    )
    servers = F.json_object_keys(F.get_json_object("content", "$.mcpServers"))
    tools = declared.select("source_id", "package", F.lit("mcp.tool").alias("kind"), F.explode(servers).alias("symbol")).withColumn("symbol", F.lower("symbol"))
    held = r"(?:^|/)commands/([A-Za-z0-9_.-]+)\.md$"
    commands = inventory.where((F.col("kind") == "file") & F.col("path").rlike(held)).select(
        "source_id", parent(parent(F.col("path"))).alias("package"), F.lower(F.regexp_extract("path", held, 1)).alias("symbol")
    )
    commands = commands.join(boundaries.select("source_id", F.col("root").alias("package")).distinct(), ["source_id", "package"])
    return tools.unionByName(commands.withColumn("kind", F.lit("plugin.command"))).distinct()
