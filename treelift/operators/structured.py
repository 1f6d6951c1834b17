"""References in JSON files: single fields, lists of files, patterns over the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.paths import ancestors, collapse, file_name, is_host_reference, parent, unquote, unquote_fully
from treelift.operators.globs import WILDCARD, match_globs
from treelift.sources.scratch import Scratch

#: Fields that name files, those of them that may hold patterns, and files that have to be JSON.
FIELDS = ["extends", "files", "include", "entrypoint", "executable", "file", "path", "runtime", "script", "source"]
PATTERN_FIELDS = ["files", "include"]
CONFIGS = ["deno.json", "jsconfig.json", "package.json", "tsconfig.json"]
UNPARSEABLE = "unparseable structured config"


def _strings(value: Column) -> Column:
    """The string, or the strings of the list, that a variant holds."""
    is_string = lambda v: F.schema_of_variant(v) == "STRING"
    listed = F.filter(F.try_variant_get(value, "$", "array<variant>"), lambda v: v.isNotNull() & is_string(v))
    return F.when(value.isNull(), F.array().cast("array<string>")).when(is_string(value), F.array(F.try_variant_get(value, "$", "string"))).otherwise(
        F.coalesce(F.transform(listed, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))
    )


def field_values(inventory: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, root, path, line, ord, field, value of JSON files below a candidate's root; field is null where a file of CONFIGS isn't JSON.

    Fields come in the order of FIELDS, paths of "references" last. Values that are no strings count for nothing, so do files whose top is no
    object; an object with repeated keys is no JSON here. line is that of the value's first occurrence, 1 where it is written with escapes.
    """
    texts = inventory.where((F.col("kind") == "file") & F.endswith(F.lower("path"), F.lit(".json")) & F.col("content").isNotNull())
    placed = texts.select("source_id", "path", "content", F.explode(ancestors(parent(F.col("path")))).alias("root")).join(candidates.select("source_id", "root"), ["source_id", "root"])
    parsed = placed.withColumn("v", F.try_parse_json("content"))
    pair = lambda field: lambda value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    nested = F.filter(F.try_variant_get("v", "$.references", "array<variant>"), lambda v: v.isNotNull())
    own = F.transform(nested, lambda v: F.try_variant_get(v, "$.path", "variant"))
    own = F.filter(own, lambda v: v.isNotNull())
    own = F.transform(F.filter(own, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    values = [F.transform(_strings(F.try_variant_get("v", f"$.{f}", "variant")), pair(f)) for f in FIELDS]
    values.append(F.coalesce(F.transform(own, pair("references.path")), F.array().cast("array<struct<field:string,value:string>>")))
    broken = F.col("v").isNull() & F.lower(file_name(F.col("path"))).isin(CONFIGS)
    failure = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(UNPARSEABLE).alias("value")))
    rows = parsed.select("source_id", "root", "path", "content", F.posexplode(F.when(broken, failure).otherwise(F.concat(*values))).alias("ord", "r"))
    before = F.expr("left(content, greatest(instr(content, r.value) - 1, 0))")
    return rows.select("source_id", "root", "path", F.size(F.split(before, "\n")).alias("line"), "ord", "r.field", "r.value")


def json_references(inventory: DataFrame, candidates: DataFrame, scratch: Scratch) -> DataFrame:
    """source_id, root, path, line, ord, syntax, value: what JSON files below candidates' roots refer to.

    A pattern stands for the files it matches below its file's folder or, if there are none, below the candidate's root, as paths from
    there. One that leads to the machine, hides '..' behind escapes, or leaves the tree without any match stays as it is; one that
    just matches nothing refers to nothing.
    """
    values = scratch.keep(field_values(inventory, candidates), "values")
    is_pattern = F.coalesce(F.col("field").isin(PATTERN_FIELDS) & F.col("value").rlike(WILDCARD), F.lit(False))
    syntax = F.when(F.col("field").isNull(), "json.parse_failure").otherwise(F.concat(F.lit("json."), "field"))
    plain = values.where(~is_pattern).select("source_id", "root", "path", "line", "ord", syntax.alias("syntax"), "value")
    globs = values.where(is_pattern).withColumns({"decoded": unquote_fully(F.col("value")), "once": unquote(F.col("value"))})
    kept = is_host_reference(F.col("decoded")) | ((F.col("decoded") != F.col("once")) & F.col("decoded").rlike(r"(?:^|/)\.\.(?:/|$)"))
    key = ["source_id", "root", "path", "line", "ord", "value"]
    bases = F.array_distinct(F.array(parent(F.col("path")), F.col("root")))
    probes = globs.select(*key, "once", kept.alias("stays"), F.posexplode(bases).alias("probe", "base"))
    probes = scratch.keep(probes.select(*key, "probe", "base", "stays", F.when(~F.col("stays"), collapse(F.col("base"), F.col("once"))).alias("pattern")), "probes")
    files = inventory.where(F.col("kind") == "file").select("source_id", "path")
    matches = match_globs(probes.select("source_id", "pattern"), files, scratch)
    hits = scratch.keep(probes.where("pattern is not null").join(matches.withColumnRenamed("path", "hit"), ["source_id", "pattern"]).select(*key, "probe", "base", "hit"), "hits")
    first = hits.groupBy(*key).agg(F.min("probe").alias("probe"))
    below = F.when(F.startswith("hit", F.concat("base", F.lit("/"))), F.expr("substr(hit, length(base) + 2)")).otherwise(F.col("hit"))
    expanded = hits.join(first, [*key, "probe"]).select(*key[:-1], below.alias("value"))
    left = probes.groupBy(*key).agg(F.bool_or("stays").alias("stays"), F.bool_or(F.col("pattern").isNull()).alias("leaves"))
    left = left.join(first, key, "left_anti").where("stays or leaves").select(*key)
    return plain.unionByName(expanded.unionByName(left).withColumn("syntax", F.lit("json.glob")))
