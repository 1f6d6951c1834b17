"""Which part of a route names a branch or tag, and which part a folder or file of its tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a commit.
COMMIT = r"\A[0-9a-f]{40}\z"


def listed_names(listing: DataFrame) -> DataFrame:
    """repo, name: branches and tags in lines of a listing (repo, line: a commit, white space, a full name); other lines count for nothing."""
    fields = F.split(F.trim("line"), r"\s+")
    name = F.regexp_extract(F.get(fields, F.lit(1)), r"^refs/(?:heads|tags)/(.+)$", 1)
    is_name = (F.size(fields) == 2) & F.get(fields, F.lit(0)).rlike(COMMIT) & (name != "") & ~F.endswith(name, F.lit("^{}"))
    return listing.where(is_name & F.col("repo").isNotNull()).select("repo", name.alias("name")).distinct()


def resolve_refs(routes: DataFrame, names: DataFrame) -> DataFrame:
    """All columns of routes, then wanted_ref, scope, target, problem.

    routes has repo, kind ('tree', 'blob' or null), route (what follows the kind), ref and subpath (null: not given).  A given ref that
    begins the route is it; else it is the longest of the repo's names (repo, name) that begins the route at a part's end; else a first
    part that is a commit.  A given ref and subpath overrule the route.  What the route has left is the scope, or for a blob the target and
    its folder the scope.  problem: 'ref' or 'subpath' if the route can't be cut without it, 'blob' if no file is left.  Without a kind or
    route there is nothing to cut.  Repeated rows stay; each different route is looked up once, through one equality per prefix.
    """
    parts = F.filter(F.split("route", "/"), lambda p: p != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("__parts")), lambda n: F.array_join(F.slice("__parts", 1, n), "/"))
    rows = routes.withColumn("__parts", F.when(F.col("kind").isNotNull(), parts))
    rows = rows.withColumn("__prefixes", F.when(F.size("__parts") > 0, prefixes))
    known = (
        rows.where(F.col("__prefixes").isNotNull() & ~F.coalesce(F.array_contains("__prefixes", F.col("ref")), F.lit(False)))
        .select("repo", "__prefixes").distinct()
        .select("repo", "__prefixes", F.posexplode("__prefixes").alias("n", "name"))
        .join(names.select("repo", "name").distinct(), ["repo", "name"])
        .groupBy("repo", "__prefixes").agg(F.max_by("name", "n").alias("__known"))
    )
    found = rows.join(known, ["repo", "__prefixes"], "left")
    first = F.get("__parts", F.lit(0))
    begins = F.array_contains("__prefixes", F.col("ref"))
    matched = F.when(begins, F.col("ref")).otherwise(F.coalesce("__known", F.when(first.rlike(COMMIT), first)))
    found = found.withColumn("__matched", matched)
    rest = F.when(F.col("__matched").isNotNull(), F.expr("slice(__parts, size(split(__matched, '/')) + 1, size(__parts))"))
    found = found.withColumn("__rest", rest)
    routed, has_subpath = F.col("__prefixes").isNotNull(), F.col("subpath").isNotNull()
    unmatched = routed & F.col("__matched").isNull()
    no_file = routed & ~has_subpath & (F.col("kind") == "blob") & (F.size("__rest") == 0)
    problem = F.when(unmatched & F.col("ref").isNull(), "ref").when(unmatched & ~has_subpath, "subpath").when(no_file, "blob")
    found = found.withColumn("problem", problem)

    def folder(items: Column) -> Column:
        return F.when(F.size(items) == 0, ".").otherwise(F.array_join(items, "/"))

    fine, is_blob = F.col("problem").isNull(), F.col("kind") == "blob"
    up = F.expr("slice(__rest, 1, greatest(size(__rest) - 1, 0))")
    scope = F.when(has_subpath, F.col("subpath")).when(~routed, ".").when(is_blob, folder(up)).otherwise(folder(F.col("__rest")))
    return found.select(
        *routes.columns,
        F.when(fine, F.coalesce("ref", "__matched")).alias("wanted_ref"),
        F.when(fine, scope).alias("scope"),
        F.when(fine & routed & ~has_subpath & is_blob, F.array_join("__rest", "/")).alias("target"),
        "problem",
    )
