"""Near duplicates among embeddings by collision-counting projections.

Two unit vectors at distance r differ by r * N(0, 1) along a Gaussian direction.  So of :data:`WINDOWS` one-dimensional projections,
a pair at the threshold collides (lies in each other's window of half width :data:`REACH` * r) in a binomial number, and a pair at
random in far fewer.  Pairs with at least :func:`least_count` collisions, which misses a pair at the threshold with a chance of at most
:data:`MISS`, are verified by their cosine in double precision.

To count all pairs' collisions would be quadratic.  The windows are therefore counted within tiles: each round sorts the vectors along
directions of its own, cuts each order at its middle, and vectors on the same sides make a tile.  The number of rounds follows from the
number of cuts, so that a pair at the threshold misses all its tiles with a chance of at most :data:`MISS`; nearer pairs less often.
Within a tile, each projection is sorted and each vector's window is a range of ranks; a pair collides if the one's rank lies in the other's range.

Equal vectors are one node with its number of copies.  A tile of over :data:`BLOCK` nodes is dealt to pairs of blocks, which
are compared wherever they lie.  No pair leaves its task: for each node the number of links that no earlier round has found, and a
spanning forest, are all that is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.llm.components import components
from treelift.sources.scratch import Scratch

COSINE = 0.95
#: Window projections, half width of a window in distances at the threshold, and the chance that a pair at the threshold is missed by the count, or by all tiles.
WINDOWS, REACH, MISS = 32, 1.28, 1e-4
TILE, BLOCK, CHUNK = 512, 2048, 256
SEED = 20_013


def least_count(windows: int = WINDOWS, reach: float = REACH, miss: float = MISS) -> int:
    """The greatest number of collisions that a pair at the threshold reaches with a chance of at least 1 - miss."""
    p = math.erf(reach / math.sqrt(2))
    below = 0.0
    for count in range(windows + 1):
        below += math.comb(windows, count) * p**count * (1 - p) ** (windows - count)
        if below > miss:
            return count
    return windows


def cuts_and_rounds(n: int, cosine: float = COSINE, tile: int = TILE, miss: float = MISS) -> tuple[int, int]:
    """Cuts of a round, so that tiles of n vectors hold about ``tile`` of them, and rounds, so that a pair at the threshold shares none with a chance of at most miss."""
    cuts = min(62, max(0, math.ceil(math.log2(max(n, 1) / tile))))
    together = (1 - math.acos(cosine) / math.pi) ** cuts
    return cuts, 1 if cuts == 0 else math.ceil(math.log(miss) / math.log1p(-together))


def directions(kind: int, number: int, size: int) -> np.ndarray:
    """Gaussian directions (size x number), the same wherever they are made."""
    return np.random.default_rng([SEED, kind, size]).standard_normal((size, number))


def _lists(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: rows' places and their vectors, of a list column without nulls."""
    sizes = np.asarray(column.value_lengths())
    ends = np.cumsum(sizes)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return {int(s): (at := np.flatnonzero(sizes == s), flat[(ends[at] - s)[:, None] + np.arange(s)]) for s in np.unique(sizes)}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; components are first divided by the greatest, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for size, (_, v) in _lists(batch.column(0)).items():
            sums[size] = sums.get(size, 0) + unit(v).sum(axis=0)
    rows = [(s, k, float(x)) for s, v in sums.items() for k, x in enumerate(v)]
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], ["size", "k", "total"])


def _middles(nodes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """By vectors' length, their mean: the sums of tasks are added by Spark, one number for each component comes back."""
    sums = nodes.select("vector").mapInArrow(_partial_sums, "size int, k int, total double").groupBy("size", "k").agg(F.sum("total").alias("total"))
    out: dict[int, dict[int, float]] = {}
    for size, k, total in sums.collect():
        out.setdefault(size, {})[k] = total / n
    return {s: np.array([v[k] for k in range(s)]) for s, v in out.items()}


def _tile_keys(cuts: int, rounds: int, middles: dict[int, np.ndarray]):
    """Adds each node's tile of every round; vectors of different lengths never share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(cuts, dtype=np.int64)
        for batch in batches:
            keys = np.zeros((batch.num_rows, rounds), dtype=np.int64)
            for size, (at, v) in _lists(batch.column("vector")).items():
                sides = (unit(v) - middles[size]) @ directions(1, cuts * rounds, size) > 0
                keys[at] = (sides.reshape(len(at), rounds, cuts) * weights).sum(axis=2)
            offsets = pa.array(np.arange(0, batch.num_rows * rounds + 1, rounds, dtype=np.int32))
            out = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            sizes = batch.column("vector").value_lengths().cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, sizes, out], [*batch.schema.names, "size", "keys"])

    return run


def collisions(sorted_by: np.ndarray, queries: np.ndarray, half: float) -> np.ndarray:
    """For each query and each row, in how many projections the row lies in the query's window. Both: rows x projections."""
    n, windows = sorted_by.shape
    out = np.zeros((len(queries), n), dtype=np.uint8)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    for k in range(windows):
        values = sorted_by[:, k]
        order = np.argsort(values, kind="stable")
        rank = np.empty(n, dtype=kind)
        rank[order] = np.arange(n, dtype=kind)
        ordered = values[order]
        low = np.searchsorted(ordered, queries[:, k] - half, "left").astype(kind)
        high = np.searchsorted(ordered, queries[:, k] + half, "right").astype(kind)
        out += (rank[None, :] - low[:, None]) < (high - low)[:, None]  # unsigned: a rank below the range wraps around
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that links lead to from each of n places."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(cosine: float, least: int):
    """Links within a tile, or between two of its blocks: of each node the copies it is newly linked with, and its place in a spanning forest."""
    half = REACH * math.sqrt(2 - 2 * cosine)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        turn, first, second = (rows.column(c)[0].as_py() for c in ("turn", "i", "j"))
        node, copies = (rows.column(c).to_numpy() for c in ("node", "copies"))
        block = rows.column("block").to_numpy()
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        (_, vectors), = _lists(rows.column("vector").combine_chunks()).values()
        x = unit(vectors)
        shadows = x @ directions(2, WINDOWS, x.shape[1])
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for start in range(0, len(left), CHUNK):
            q = left[start : start + CHUNK]
            near = collisions(shadows[right], shadows[q], half) >= least
            near &= right[None, :] > q[:, None] if first == second else True
            a, b = np.nonzero(near)
            if len(a) > 0.05 * near.size:
                found = (x[q] @ x[right].T)[a, b] >= cosine
            else:
                found = np.einsum("ij,ij->i", x[q[a]], x[right[b]]) >= cosine
            ends.append((q[a[found]], right[b[found]]))
        a, b = np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])
        new = np.ones(len(a), dtype=bool)
        for earlier in range(turn):
            new[new] = keys[a[new], earlier] != keys[b[new], earlier]
        links = np.bincount(a[new], copies[b[new]], len(node)) + np.bincount(b[new], copies[a[new]], len(node))
        root = forest(a, b, len(node))
        told = np.flatnonzero((links > 0) | (root != np.arange(len(node))))
        return pa.table({"node": node[told], "links": links[told].astype(np.int64), "root": node[root[told]]})

    return run


def _node_links(nodes: DataFrame, rounds: int, cosine: float, least: int) -> DataFrame:
    """node, links, root, in rows of the tiles where links were found. nodes: node, vector, copies, size, keys."""
    placed = nodes.select("*", F.posexplode("keys").alias("turn", "tile"))
    crowded = placed.groupBy("turn", "tile", "size").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("held") / BLOCK), F.lit(1)).cast("int")
    dealt = placed.join(crowded, ["turn", "tile", "size"], "left").withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "turn"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = dealt.select("turn", "tile", "size", "node", "vector", "copies", "keys", "block", other)
    units = units.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    return units.groupBy("turn", "tile", "size", "i", "j").applyInArrow(_compare(cosine, least), "node long, links long, root long")


def link_embeddings(embeddings: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of embeddings (vec_id, embedding), whatever other columns they have.

    A vector that is null, empty or zero, or holds a null or a component that isn't finite, is linked with nothing, and its component
    is itself. Vectors of different lengths are not linked. Equal vectors are linked, whatever their ids; rows with one vec_id
    stay rows.  A row without a vec_id counts as a link, is never kept and gives its component no name.
    """
    scratch = Scratch(embeddings.sparkSession, "vectors")
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(finite, F.lit(False))
    vectors = given.where(usable)
    node = vectors.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    nodes = scratch.keep(node.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    cuts, rounds = cuts_and_rounds(n, cosine, tile)
    keyed = nodes.select("node", "copies", "vector").mapInArrow(_tile_keys(cuts, rounds, _middles(nodes, max(n, 1))), "node long, copies long, vector array<double>, size int, keys array<long>")
    keyed = scratch.keep(keyed, "keyed")
    found = scratch.keep(_node_links(keyed, rounds, cosine, least_count()), "found")
    scratch.drop(keyed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("node <> root").select("node", "root").distinct()
    parts = components(edges, scratch)
    least = nodes.select("node", "copies", "least")
    whole = least.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    told = whole.join(names, "component").join(links, "node", "left")
    told = told.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    named = vectors.join(nodes.select("vector", "node"), "vector").select("vec_id", "node").join(told, "node").select("vec_id", "n_links", "component_id")
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
