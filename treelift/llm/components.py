"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch, in_few_tasks

LOCAL_LINKS = 200_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task, some LOCAL_LINKS at a time, to links of every node with the smallest one that they join it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def drain() -> pa.RecordBatch:
        rows = [(x, r) for x in list(up) if (r := find(x)) != x]
        up.clear()
        columns = list(zip(*rows, strict=True)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((find(a), find(b)))
            up[high] = low
        if len(up) > LOCAL_LINKS:
            yield drain()
    yield drain()


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest node around it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = in_few_tasks(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), rows)
    joined = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return in_few_tasks(in_few_tasks(joined.where("u <> v"), rows).distinct(), rows)


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """A node and its neighbours below it are linked to the smallest of them. edges: u > v."""
    least = in_few_tasks(edges.groupBy("u").agg(F.min("v").alias("m")), rows)
    moved = in_few_tasks(edges.join(least, "u"), rows)
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .where("u <> v")
    )


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node that has a link. links: two long columns.

    Links that meet in a task are joined there first.  Each round is written to the shared folder, where the round before is
    deleted; a hub with many links is pre-aggregated for its minimum and its join can be split, so no task holds
    all of a hub's links.
    """
    a, b = links.columns
    edges = scratch.keep(links.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(_local_stars, "u long, v long"), "links")
    mark, rows = None, edges.count()
    while True:
        stars = in_few_tasks(_small_star(_large_star(edges, rows), rows).distinct(), rows)
        stars = scratch.keep(stars, "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(edges)
        edges, rows = stars, now[0]
        if now == mark:
            break
        mark = now
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
