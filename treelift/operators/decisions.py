"""From evidence to a class for every candidate, and groups over the candidates."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelift.functions.identity import group_ids
from treelift.functions.paths import ancestors, bounded, parent
from treelift.sources.scratch import Scratch

EVIDENCE_LIMIT = 64
#: Codes that block a candidate, and codes that bind it to its package.
BLOCKED = ["SYMLINK_ESCAPE", "SYMLINK_CYCLE", "PATH_TRAVERSAL", "PATH_COLLISION", "FILE_TOO_LARGE", "SCAN_LIMIT_EXCEEDED"]
BOUND = [
    "PLUGIN_ROOT_VARIABLE",
    "REFERENCE_OUTSIDE_SKILL_ROOT",
    "PLUGIN_OWNED_MCP_TOOL",
    "PLUGIN_COMMAND_REFERENCE",
    "PLUGIN_RUNTIME_FILE_REFERENCE",
    "PLUGIN_RUNTIME_INSIDE_SKILL_ROOT",
    "REFERENCED_BY_PLUGIN_RUNTIME",
    "MISSING_LOCAL_RESOURCE",
    "DYNAMIC_REFERENCE_UNRESOLVED",
]
CLASSES = ["portable", "plugin_bound", "ambiguous", "invalid", "blocked"]


def evidence(resolved: DataFrame, refs: DataFrame, candidates: DataFrame, validation: DataFrame, callers: DataFrame | None = None) -> DataFrame:
    """source_id, root, code, path, line, ord, value: one row for each finding, in the order in which they count."""
    code = (
        F.when(F.col("outcome") == "escape", "PATH_TRAVERSAL")
        .when(F.col("outcome") == "outside", "REFERENCE_OUTSIDE_SKILL_ROOT")
        .when(F.col("outcome") == "missing", "MISSING_LOCAL_RESOURCE")
        .when(F.col("outcome") == "dynamic", "DYNAMIC_REFERENCE_UNRESOLVED")
    )
    shown = F.when(F.col("target").isNotNull(), F.concat("value", F.lit(" -> "), "target")).otherwise(F.col("value"))
    forward = resolved.withColumn("code", code).where("code is not null").select("source_id", "root", "code", "path", "line", "ord", bounded(shown).alias("value"))
    roots = candidates.select("source_id", "root")
    variables = (
        refs.where(F.col("syntax") == "plugin.variable")
        .withColumn("root", F.explode(ancestors(parent(F.col("path")))))
        .join(roots, ["source_id", "root"])
        .select("source_id", "root", F.lit("PLUGIN_ROOT_VARIABLE").alias("code"), "path", "line", "ord", bounded(F.col("value")).alias("value"))
    )
    invalid = (
        validation.where("not valid")
        .join(candidates.select("source_id", "root", "entrypoint"), ["source_id", "root"])
        .select("source_id", "root", F.lit("INVALID_FRONTMATTER").alias("code"), F.col("entrypoint").alias("path"), F.lit(1).alias("line"), F.lit(0).alias("ord"), F.col("problem").alias("value"))
    )
    found = forward.unionByName(variables).unionByName(invalid)
    if callers is not None:
        found = found.unionByName(
            callers.select("source_id", "root", F.lit("REFERENCED_BY_PLUGIN_RUNTIME").alias("code"), "path", "line", "ord", bounded(F.col("value")).alias("value"))
        )
    return found


_FINDING = ["source_id", "root", "code", "path", "line", "ord", "value"]
_NONE = "CAST(NULL AS INT)"


def _below(rows: DataFrame, candidates: DataFrame, path: str = "path") -> DataFrame:
    """Rows once for each candidate root around their path."""
    return rows.withColumn("root", F.explode(ancestors(parent(F.col(path))))).join(candidates.select("source_id", "root"), ["source_id", "root"])


def collision_evidence(inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """Paths below a candidate that differ from another path of the source only in case or composition."""
    paths = inventory.select("source_id", "path").where("path is not null").distinct()
    keyed = Scratch(inventory.sparkSession, "paths").keep(paths.mapInArrow(_path_with_key, "source_id string, path string, path_key string"), "keys")
    shared = keyed.groupBy("source_id", "path_key").agg(F.count("*").alias("n")).where("n > 1").select("source_id", "path_key")
    rows = _below(keyed.join(shared, ["source_id", "path_key"]), candidates)
    return rows.withColumns({"code": F.lit("PATH_COLLISION"), "line": F.expr(_NONE), "ord": F.lit(0), "value": bounded(F.col("path_key"))}).select(*_FINDING)


def limit_evidence(inventory: DataFrame, candidates: DataFrame, entries: int | None = None, total: int | None = None, single: int = 10 << 20, depth: int = 64) -> DataFrame:
    """Files over the limit of a file block the candidate around them; a source over a limit on all of it blocks all its candidates."""
    large = _below(inventory.where((F.col("kind") == "file") & (F.col("size") > single)), candidates)
    found = large.withColumns({"code": F.lit("FILE_TOO_LARGE"), "line": F.expr(_NONE), "ord": F.lit(0), "value": F.col("size").cast("string")}).select(*_FINDING)
    sums = inventory.groupBy("source_id").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("bytes"),
        F.max(F.size(F.split("path", "/"))).alias("deepest"),
    )
    over = (
        F.when(F.lit(entries is not None) & (F.col("n") > (entries or 0)), "entries")
        .when(F.lit(total is not None) & (F.col("bytes") > (total or 0)), "bytes")
        .when(F.col("deepest") > depth, "depth")
    )
    whole = candidates.select("source_id", "root", F.col("entrypoint").alias("path")).join(sums.select("source_id", over.alias("value")).where("value is not null"), "source_id")
    whole = whole.withColumns({"code": F.lit("SCAN_LIMIT_EXCEEDED"), "line": F.expr(_NONE), "ord": F.lit(0)})
    return found.unionByName(whole.select(*_FINDING))


def package_evidence(boundaries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Packages with a runtime of their own that lie inside a candidate, and a second entrypoint beside the one that counts."""
    mixed = boundaries.where(F.col("package_kind") == "mixed")
    inside = mixed.select("source_id", F.col("manifest_path").alias("path"), F.explode(ancestors(F.col("root"))).alias("root"))
    inside = inside.join(candidates.select("source_id", "root"), ["source_id", "root"])
    inside = inside.withColumns({"code": F.lit("PLUGIN_RUNTIME_INSIDE_SKILL_ROOT"), "value": F.lit("mixed")})
    second = candidates.where("both").select("source_id", "root", F.col("entrypoint").alias("path"))
    second = second.withColumns({"code": F.lit("DUPLICATE_ENTRYPOINT"), "value": F.concat(F.lit("ignored in favor of "), "path")})
    return inside.unionByName(second).withColumns({"line": F.expr(_NONE), "ord": F.lit(0)}).select(*_FINDING)


def symbol_evidence(refs: DataFrame, candidates: DataFrame, owned: DataFrame) -> DataFrame:
    """Tools and commands in a candidate's files that a package around it owns.

    refs: with syntax mcp.tool or plugin.command. owned: source_id, package, kind, symbol (in lower case).
    """
    symbol = F.when(F.col("syntax") == "mcp.tool", F.regexp_extract("value", "^mcp__(.+)__", 1)).otherwise(F.regexp_replace("value", "^/", ""))
    rows = _below(refs.where(F.col("syntax").isin("mcp.tool", "plugin.command")).withColumn("symbol", F.lower(symbol)), candidates)
    code = F.when(F.col("kind") == "mcp.tool", "PLUGIN_OWNED_MCP_TOOL").otherwise("PLUGIN_COMMAND_REFERENCE")
    around = rows.withColumn("package", F.explode(ancestors(F.col("root")))).withColumnRenamed("syntax", "kind")
    found = around.join(owned.distinct(), ["source_id", "package", "kind", "symbol"]).withColumn("code", code)
    return found.select("source_id", "root", "code", "path", "line", "ord", bounded(F.col("value")).alias("value")).distinct()


def reasons(found: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """source_id, root, code, n_attempts, evidence: the first findings of a code up to the limit count, then repeats fall together."""
    order = Window.partitionBy("source_id", "root", "code").orderBy("path", "line", "ord")
    kept = found.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= limit)
    return kept.groupBy("source_id", "root", "code").agg(
        F.count("*").alias("n_attempts"), F.array_sort(F.collect_set(F.struct("path", "line", "value"))).alias("evidence")
    )


def classification(has: dict[str, Column], package_kind: Column) -> Column:
    """Class by precedence: blocked, invalid, plugin_bound, ambiguous, and else by the package around."""
    return (
        F.when(has["blocked"], "blocked")
        .when(has["invalid"], "invalid")
        .when(has["bound"], "plugin_bound")
        .when(has["incomplete"], "ambiguous")
        .when(package_kind.isNull() | (package_kind == "skills_only"), "portable")
        .otherwise("ambiguous")
    )


def classify(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """source_id, root, classification, base_reason."""
    flags = found.groupBy("source_id", "root").agg(
        F.bool_or(F.col("code").isin(BLOCKED)).alias("blocked"),
        F.bool_or(F.col("code") == "INVALID_FRONTMATTER").alias("invalid"),
        F.bool_or(F.col("code").isin(BOUND)).alias("bound"),
        F.bool_or(F.col("code") == "STATIC_ANALYSIS_INCOMPLETE").alias("incomplete"),
    )
    joined = candidates.join(flags, ["source_id", "root"], "left")
    has = {name: F.coalesce(F.col(name), F.lit(False)) for name in ("blocked", "invalid", "bound", "incomplete")}
    kind = F.col("package_kind")
    label = classification(has, kind)
    base = (
        F.when((label == "portable") & kind.isNull(), "STANDALONE_NO_PLUGIN_BOUNDARY")
        .when(label == "portable", "SKILLS_ONLY_PACKAGE")
        .when((label == "ambiguous") & (kind == "mixed"), "MIXED_PLUGIN_AUTONOMY_UNPROVEN")
    )
    return joined.select("source_id", "root", label.alias("classification"), base.alias("base_reason"))


def limit_checks(inventory: DataFrame, entries: int = 10_000, total: int = 250 << 20, single: int = 10 << 20, depth: int = 64) -> DataFrame:
    """source_id, n_entries, n_bytes, largest, deepest, within: whether a source keeps its operation's limits."""
    found = inventory.groupBy("source_id").agg(
        F.count("*").alias("n_entries"),
        F.sum(F.when(F.col("kind") == "file", F.col("size")).otherwise(0)).alias("n_bytes"),
        F.max("size").alias("largest"),
        F.max(F.size(F.split("path", "/"))).alias("deepest"),
    )
    keeps = (F.col("n_entries") <= entries) & (F.col("n_bytes") <= total) & (F.col("largest") <= single) & (F.col("deepest") <= depth)
    return found.withColumn("within", keeps)


def path_collisions(inventory: DataFrame) -> DataFrame:
    """source_id, path_key, n: paths of a source that differ only in case or in how their characters are composed."""
    paths = inventory.select("source_id", "path").where("path is not null").distinct()
    keyed = paths.mapInArrow(_path_with_key, "source_id string, path string, path_key string")
    return keyed.groupBy("source_id", "path_key").agg(F.count("*").alias("n")).where("n > 1")


def _path_with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, path) to (source_id, path, path_key): NFC, then case folded. Broken UTF-8 stays as it is."""
    for batch in batches:
        paths = (p.decode("utf-8", "surrogateescape") for p in batch.column(1).cast(pa.binary()).to_pylist())
        keys = [unicodedata.normalize("NFC", p).casefold().encode("utf-8", "surrogateescape") for p in paths]
        binary = pa.array(keys, pa.binary())
        key = pa.Array.from_buffers(pa.string(), len(binary), binary.buffers())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), key], ["source_id", "path", "path_key"])


def class_counts(classified: DataFrame) -> DataFrame:
    """source_id, total, and the number of candidates of every class, zeros included."""
    return classified.groupBy("source_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("classification") == c).alias(c) for c in CLASSES))


def groups(members: DataFrame, kind: str, key: str) -> DataFrame:
    """source_id, key, n, representative, group_id of keys that several candidates share. members: source_id, root, candidate_id and the key.

    Sizes and representatives are aggregated before the shuffle; the ids of a group are hashed as a sorted stream, so no row or
    task holds a group.
    """
    rows = members.select("source_id", "root", "candidate_id", F.col(key).alias("key")).where("key is not null and key <> ''")
    shared = rows.groupBy("source_id", "key").agg(
        F.count("*").alias("n"), F.min(F.struct("root", "candidate_id"))["root"].alias("representative")
    ).where("n > 1")
    ids = group_ids(rows.join(shared.select("source_id", "key"), ["source_id", "key"], "left_semi"), kind)
    return shared.join(ids, ["source_id", "key"]).select("source_id", "key", "n", "representative", "group_id")


def destinations(records: DataFrame) -> DataFrame:
    """records (source_id, slug, content_hash) with the shortest prefix of the hash, from 12 digits on, that makes a name its own.

    Names that differ at twelve digits differ at more; so only records that share the first are compared further.
    """
    name = F.lower(F.concat("slug", F.lit("--"), F.substr("content_hash", F.lit(1), F.lit(12))))
    named = records.select("source_id", "slug", "content_hash", name.alias("name"))
    shared = named.groupBy("source_id", "name").agg(F.count("*").alias("c")).where("c > 1").select("source_id", "name")
    again = named.join(shared, ["source_id", "name"]).select("source_id", "slug", "content_hash", F.explode(F.sequence(F.lit(13), F.lit(63))).alias("n"))
    again = again.withColumn("name", F.lower(F.concat("slug", F.lit("--"), F.substr("content_hash", F.lit(1), F.col("n")))))
    free = again.groupBy("source_id", "n", "name").agg(F.count("*").alias("c"), F.first("slug").alias("slug"), F.first("content_hash").alias("content_hash"))
    least = free.where("c = 1").groupBy("source_id", "slug", "content_hash").agg(F.min("n").alias("least"))
    longer = again.select("source_id", "slug", "content_hash").distinct().join(least, ["source_id", "slug", "content_hash"], "left")
    longer = longer.withColumn("n", F.coalesce("least", F.lit(64))).drop("least")
    joined = records.join(longer, ["source_id", "slug", "content_hash"], "left")
    prefix = F.substr("content_hash", F.lit(1), F.coalesce("n", F.lit(12)))
    return joined.select("source_id", "slug", "content_hash", F.concat("slug", F.lit("--"), prefix).alias("destination"))


def review_outcome(classified: DataFrame, reviews: DataFrame, least: float = 0.9) -> DataFrame:
    """Classes after an outside review: only ambiguous candidates change, and to portable only with enough confidence."""
    joined = classified.join(reviews, ["source_id", "root"], "left")
    open_ = F.col("classification") == "ambiguous"
    verdict, sure = F.col("verdict"), F.coalesce(F.col("confidence") >= least, F.lit(False))
    final = F.when(open_ & (verdict == "plugin_bound"), "plugin_bound").when(open_ & (verdict == "portable") & sure, "portable").otherwise(F.col("classification"))
    code = (
        F.when(~open_, F.lit(None))
        .when(verdict.isNull(), "FM_UNAVAILABLE")
        .when((verdict == "portable") & sure, "FM_PORTABLE_VERIFIED")
        .when(verdict == "portable", "FM_LOW_CONFIDENCE")
        .otherwise(F.concat(F.lit("FM_"), F.upper(verdict)))
    )
    return joined.select("source_id", "root", "classification", final.alias("final"), code.alias("review_code"))


#: Ends of key names whose values are secrets, and the marks around repository data in a prompt.
SECRET_KEYS = {
    "PASSWORD": ["password", "passwd", "passphrase"],
    "PRIVATE_KEY": ["privatekey"],
    "TOKEN": ["token", "apikey", "secret", "secretkey", "secretaccesskey", "accesskeyid", "accesskey"],
}
PROMPT_DELIMITER = "UNTRUSTED_REPOSITORY_DATA_(?:BEGIN|END)"
REDACTED = "<REDACTED:"


def _key_end(marker: str) -> str:
    ends = "|".join("[_.-]*".join(end) for end in SECRET_KEYS[marker])
    return rf"""(?:{ends})[_.-]*['"]?\s*[=:]\s*"""


def secret_key_pattern(marker: str) -> str:
    """A key and its sign of assignment. Only letters and digits of a key count, so its end may hold dots, dashes and underscores."""
    return rf"""(?i)(['"]?(?:[A-Za-z_][A-Za-z0-9_.-]*?)?{_key_end(marker)})"""


def _with(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _assignments(whole: str, held: str, marker: str) -> Callable[[Column], Column]:
    """Replaces assignments. Most texts have no key's end, which is found in one pass; the whole pattern tries each word from every letter."""
    return lambda x: F.when(x.rlike(f"(?i){held}"), F.regexp_replace(x, whole, f"$1{REDACTED}{marker}>")).otherwise(x)


def redact(content: Column) -> Column:
    """Text without private keys, the values of password, key and token assignments, bearer tokens and prompt delimiters."""

    def keys(out: Column) -> Column:
        for marker in SECRET_KEYS:
            value = r"""(?:"[^\r\n"]*"|'[^\r\n']*'|(?!<REDACTED)[^\s,#;}\]'"]+)"""
            out = _with(out, _assignments(secret_key_pattern(marker) + value, _key_end(marker), marker))
        return F.regexp_replace(out, r"(?im)((?<![A-Za-z0-9_])(?:proxy-)?authorization\s*:\s*Bearer\s+)[A-Za-z0-9._~+/=-]+", f"$1{REDACTED}TOKEN>")

    def has(text: Column, *marks: str) -> Column:
        found = [F.contains(text, F.lit(m)) for m in marks]
        return found[0] if len(found) == 1 else found[0] | found[1]

    # a pattern only runs over texts with a mark that each of its matches holds; keys and tokens are assigned by one of two signs
    private = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----"
    out = F.when(has(content, "-----BEGIN "), F.regexp_replace(content, private, f"{REDACTED}PRIVATE_KEY>")).otherwise(content)
    out = _with(out, lambda x: F.when(has(x, "=", ":"), keys(x)).otherwise(x))
    return _with(out, lambda x: F.when(has(x, "UNTRUSTED_REPOSITORY_DATA_"), F.regexp_replace(x, PROMPT_DELIMITER, f"{REDACTED}PROMPT_DELIMITER>")).otherwise(x))


def redaction(content: Column) -> Column:
    """redacted text, the types of what was redacted (sorted), and the numbers of the lines that are unchanged (none if lines went)."""
    count = lambda text, t: F.size(F.split(text, f"{REDACTED}{t}>"))

    def compared(out: Column) -> Column:
        found = F.array_compact(F.array(*(F.when(count(out, t) > count(content, t), t) for t in sorted([*SECRET_KEYS, "PROMPT_DELIMITER"]))))
        before, after = F.split(content, "\n"), F.split(out, "\n")
        same = F.filter(F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda x, i: F.when(x["a"] == x["b"], i + 1)), lambda x: x.isNotNull())
        return F.struct(out.alias("redacted"), found.alias("types"), F.when(F.size(before) == F.size(after), same).otherwise(F.array().cast("array<int>")).alias("unchanged"))

    def untouched(out: Column) -> Column:
        lines = F.sequence(F.lit(1), F.length(out) - F.length(F.replace(out, F.lit("\n"), F.lit(""))) + 1)
        return F.struct(out.alias("redacted"), F.array().cast("array<string>").alias("types"), lines.alias("unchanged"))

    # most texts hold no secret: nothing is split or counted for them
    return _with(redact(content), lambda out: F.when(out == content, untouched(out)).otherwise(compared(out)))


#: Names and ends of files that may hold credentials.
SENSITIVE_NAMES = [
    ".env",
    ".git-credentials",
    ".netrc",
    ".npmrc",
    ".pypirc",
    "auth.json",
    "credentials",
    "credentials.json",
    "id_dsa",
    "id_ecdsa",
    "id_ed25519",
    "id_rsa",
    "service-account.json",
    "service_account.json",
]
SENSITIVE_ENDS = [".key", ".pem", ".p12", ".pfx", ".jks", ".keystore"]


def is_sensitive(path: Column) -> Column:
    """Whether any part of a path names a file or folder of credentials; such files are never sent to a reviewer."""
    parts = F.split(F.lower(path), "/")

    def named(part: Column) -> Column:
        hit = part.isin(SENSITIVE_NAMES) | F.startswith(part, F.lit(".env.")) | F.contains(part, F.lit("credential"))
        for end in SENSITIVE_ENDS:
            hit = hit | F.endswith(part, F.lit(end))
        return hit

    docker = F.array_contains(parts, ".docker") & (F.element_at(parts, -1) == "config.json")
    return F.exists(parts, named) | docker
