"""JSON texts as variants, and a bounded walk through all of their nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: nodes of one text that are looked at.
MOST_NODES = 4096
_NODES = "array<struct<depth:int,key:string,value:variant>>"


def parse_whole(text: Column) -> Column:
    """The JSON value that is all of a text, as a variant; null if the text is none, has something behind it, or repeats a key of an object.

    The parser stops behind the first value, so the text goes into a list before a mark that it can't hold: its own digest.
    """
    marked = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.sha2(text, 256), F.lit('"]')))
    return F.when(F.try_variant_get(marked, "$[1]", "string") == F.sha2(text, 256), F.try_variant_get(marked, "$[0]", "variant"))


def walk(text: Column, most: int = MOST_NODES) -> Column:
    """(depth, key, value) of each node of a JSON text, level by level, the top first; items of a list have no key.  Null if the text is no JSON.

    A fold over levels: each step opens the nodes of the last level.  No text has more levels than opening brackets, and a walk that has met
    more than ``most`` nodes opens no further level, so one row does bounded work but for its widest level.  All of it stays in one expression.
    """
    none = F.array().cast(_NODES)

    def opened(node: Column) -> Column:
        fields = F.transform(F.map_entries(F.try_variant_get(node["value"], "$", "map<string,variant>")), lambda e: F.struct((node["depth"] + 1).alias("depth"), e["key"].alias("key"), e["value"].alias("value")))
        items = F.transform(F.try_variant_get(node["value"], "$", "array<variant>"), lambda v: F.struct((node["depth"] + 1).alias("depth"), F.lit(None).cast("string").alias("key"), v.alias("value")))
        return F.coalesce(fields.cast(_NODES), items.cast(_NODES), none)

    def step(s: Column, _: Column) -> Column:
        level = F.flatten(F.transform(s["level"], opened))
        level = F.when((F.size(s["level"]) > 0) & (F.size(s["seen"]) <= most), level).otherwise(none)
        return F.transform(F.array(level), lambda x: F.struct(x.alias("level"), F.concat(s["seen"], x).alias("seen")))[0]

    top = F.array(F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("key"), parse_whole(text).alias("value"))).cast(_NODES)
    brackets = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    steps = F.sequence(F.lit(0), F.least(brackets, F.lit(most)))
    return F.when(parse_whole(text).isNotNull(), F.aggregate(steps, F.struct(top.alias("level"), top.alias("seen")), step, lambda s: s["seen"]))
