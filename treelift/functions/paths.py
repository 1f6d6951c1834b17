"""Relative POSIX paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """'.', every directory above, and the path itself: equi-joining on it replaces a prefix join."""
    parts = F.split(path, "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(path == ".", F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), chain))


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.when(path == ".", 0).otherwise(F.size(F.split(path, "/")))


def is_within(path: Column, root: Column) -> Column:
    return (root == ".") | (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def relative_to(path: Column, root: Column) -> Column:
    """The path below a root that holds it; null for the root itself."""
    return F.when(root == ".", path).when(path == root, F.lit(None)).otherwise(F.substr(path, F.length(root) + 2))


def join_path(base: Column, value: Column) -> Column:
    return F.when(base == ".", value).otherwise(F.concat(base, F.lit("/"), value))


def collapse(base: Column, value: Column) -> Column:
    """The path that a reference means, '.' and '..' resolved lexically; null if it leaves the tree."""
    start = F.struct(F.when(base == ".", F.array().cast("array<string>")).otherwise(F.split(base, "/")).alias("parts"), F.lit(False).alias("left"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        empty = F.size(acc["parts"]) == 0
        stay = (part == "") | (part == ".")
        parts = (
            F.when(stay, acc["parts"])
            .when(up & ~empty, F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0))))
            .when(up, acc["parts"])
            .otherwise(F.array_append(acc["parts"], part))
        )
        return F.struct(parts.alias("parts"), (acc["left"] | (up & empty)).alias("left"))

    def end(acc: Column) -> Column:
        joined = F.when(F.size(acc["parts"]) == 0, F.lit(".")).otherwise(F.array_join(acc["parts"], "/"))
        return F.when(~acc["left"], joined)

    return F.aggregate(F.split(value, "/"), start, step, end)


def unquote(value: Column) -> Column:
    """Percent-decodes once; a plus sign stays, and what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def unquote_fully(value: Column, rounds: int = 8) -> Column:
    """Percent-decodes again and again; a fold over the rounds, as nested calls would double the expression each time."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), value, lambda decoded, _: unquote(decoded))


def is_host_reference(value: Column) -> Column:
    """References to the machine outside the tree: file: URLs, absolute and home paths, drives, backslashes, NUL."""
    return F.lower(value).startswith("file:") | value.rlike(r"^(?:/|~/|[A-Za-z]:[\\/])") | value.rlike(r"[\\\x00]")


def is_local_reference(value: Column) -> Column:
    return (value != "") & ~value.rlike(r"^(?:#|//|[A-Za-z][A-Za-z0-9+.-]*:)")


def is_normalized(path: Column) -> Column:
    """Relative, without NUL, backslash, drive, empty, '.' or '..' parts."""
    return (path != "") & ~path.rlike(r"[\\\x00]|^[A-Za-z]:|^/|/$|//|(?:^|/)\.\.?(?:/|$)")


def bounded(value: Column, limit: int = 256) -> Column:
    return F.when(F.length(value) > limit, F.concat(F.substr(value, F.lit(1), F.lit(limit - 3)), F.lit("..."))).otherwise(value)


def component_key(value: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "")
