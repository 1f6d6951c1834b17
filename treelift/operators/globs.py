"""Patterns over the paths of trees, matched segment by segment through equi-joins.

A pattern counts from the right, as a path may lie deeper than the pattern says: one of m segments meets the last m parts of a path.
Literal segments are taken over in runs, each segment with a wildcard joins the names below the prefix found so far, and only names that
exist there are tried.  Patterns and paths are never paired up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

#: What makes a segment more than a name.
WILDCARD = r"[*?\[]"


def segment_regex(segment: Column) -> Column:
    """A regular expression for one segment: '*' any text, '?' one character, '[a-c]' and '[!a-c]' sets; a bracket that isn't closed is itself.

    A range whose ends are in the wrong order holds nothing; a set of nothing never matches, and its opposite matches any character.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(segment, r"\*+", "*"), F.lit(r"(?s)\[!?+\]?+[^\]]*\]|."), F.lit(0))

    def escaped(char: Column) -> Column:
        return F.when(char.rlike(r"^[A-Za-z0-9_]$") | (F.octet_length(char) > 1), char).otherwise(F.concat(F.lit("\\"), char))

    def member(item: Column) -> Column:
        first, last = F.substr(item, F.lit(1), F.lit(1)), F.substr(item, F.lit(3), F.lit(1))
        return F.when(F.length(item) == 1, escaped(item)).when(first <= last, F.concat(escaped(first), F.lit("-"), escaped(last))).otherwise("")

    def part(token: Column) -> Column:
        negated = F.startswith(token, F.lit("[!"))
        body = F.substr(token, F.when(negated, 3).otherwise(2), F.length(token) - F.when(negated, 3).otherwise(2))
        inner = F.array_join(F.transform(F.regexp_extract_all(body, F.lit("(?s).-.|."), F.lit(0)), member), "")
        chosen = F.when(inner == "", F.when(negated, ".").otherwise("(?!)")).otherwise(F.concat(F.when(negated, "[^").otherwise("["), inner, F.lit("]")))
        return F.when(token == "*", ".*").when(token == "?", ".").when(F.length(token) > 1, chosen).otherwise(escaped(token))

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, part), ""), F.lit(r"\z"))


def variants(pattern: Column) -> Column:
    """Lists of segments: the pattern, and what is left of it without its first, first two, ... inner segments '**'."""
    segments = F.split(pattern, "/")
    last = F.size(segments) - 1
    inner = F.filter(F.transform(segments, lambda s, i: F.when((s == "**") & (i > 0) & (i < last), i)), lambda i: i.isNotNull())
    return F.transform(
        F.sequence(F.lit(0), F.size(inner)),
        lambda k: F.filter(segments, lambda s, i: ~F.array_contains(F.slice(inner, 1, k), i)),
    )


def _joined(*parts: Column) -> Column:
    return F.array_join(F.concat(*parts), "/")


def match_globs(patterns: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """source_id, pattern, path: the paths that each pattern (source_id, pattern) of their source matches, each once.

    Patterns are relative and free of '.' and '..' parts; an inner '**' stands for no folder or one, as any other '**' stands for one.
    Null patterns and paths match nothing.  There are as many rounds as the pattern richest in wildcards has segments with one.
    """
    wanted = patterns.where("source_id is not null and pattern is not null").select("source_id", "pattern").distinct()
    owners = scratch.keep(wanted.withColumn("segments", F.explode(variants(F.col("pattern")))), "patterns")
    wild = F.filter(F.transform("segments", lambda s, i: F.when(s.rlike(WILDCARD), i)), lambda i: i.isNotNull())
    states = owners.select("source_id", "segments").distinct().select("*", F.size("segments").alias("m"), wild.alias("wild"), F.array().cast("array<string>").alias("found"))
    states = scratch.keep(states, "states")
    # lengths and places of wildcards are bounded by the depth of the longest pattern
    places = states.groupBy("source_id").agg(F.collect_set(F.struct("m", "wild")).alias("shapes"))
    shapes = F.flatten(F.transform("shapes", lambda s: F.transform(s["wild"], lambda k: F.struct(s["m"].alias("m"), k.alias("k")))))
    places = places.select("source_id", F.array_distinct(F.transform("shapes", lambda s: s["m"])).alias("lengths"), F.array_distinct(shapes).alias("shapes"))
    files = paths.where("source_id is not null and path is not null").select("source_id", "path", F.split("path", "/").alias("parts"))
    tails = scratch.keep(
        files.join(places, "source_id")
        .select("source_id", "path", "parts", "shapes", F.explode(F.filter("lengths", lambda m: m <= F.size("parts"))).alias("m"))
        .select("source_id", "path", "m", F.expr("slice(parts, size(parts) - m + 1, m)").alias("tail"), F.expr("transform(filter(shapes, s -> s.m = m), s -> s.k)").alias("ks")),
        "tails",
    )
    names = scratch.keep(
        tails.select("source_id", "m", "tail", F.explode("ks").alias("k"))
        .select("source_id", "m", "k", F.array_join(F.expr("slice(tail, 1, k)"), "/").alias("prefix"), F.expr("tail[k]").alias("name"))
        .distinct(),
        "names",
    )
    rounds = states.agg(F.max(F.size("wild"))).first()[0] or 0
    ended = []
    for r in range(rounds + 1):
        start = F.lit(0) if r == 0 else F.get("wild", F.lit(r - 1)) + 1
        is_last = F.size("wild") == r
        rest = F.slice("segments", start + 1, F.greatest(F.col("m") - start, F.lit(0)))
        ended.append(states.where(is_last).select("source_id", "segments", "m", _joined(F.col("found"), rest).alias("whole")))
        if r == rounds:
            break
        k = F.get("wild", F.lit(r))
        going = states.where(~is_last).select(
            "source_id", "segments", "wild", "m", k.alias("k"), F.concat("found", F.slice("segments", start + 1, k - start)).alias("found"),
            segment_regex(F.get("segments", k)).alias("regex"),
        ).withColumn("prefix", F.array_join("found", "/"))
        met = going.join(names, ["source_id", "m", "k", "prefix"]).where(F.expr("name rlike regex"))
        states = scratch.keep(met.select("source_id", "segments", "m", "wild", F.array_append("found", F.col("name")).alias("found")), "states")
    whole = ended[0]
    for more in ended[1:]:
        whole = whole.unionByName(more)
    hits = whole.join(tails.select("source_id", "m", F.array_join("tail", "/").alias("whole"), "path"), ["source_id", "m", "whole"])
    return hits.join(owners, ["source_id", "segments"]).select("source_id", "pattern", "path").distinct()
