"""Hard negatives by zone maps over Hilbert-ordered blocks.

Candidate rows are ordered by label, then along a Hilbert curve through all dimensions (those that vary most come first), and written
as Parquet in blocks of :data:`BLOCK_ROWS` rows.  A block's zone map has the least and the greatest value of each dimension, its labels and
its least id; it is read without the block.  For an anchor a, interval arithmetic bounds the inner products with all rows of a block:
the sum over dimensions of the larger (smaller) of a_d * least_d and a_d * greatest_d.  A block is read for a window of scores only
if its bounds meet the window and can still better the window's fifth row so far.

A search has two rounds.  The first reads the few most promising blocks of each range of blocks, so that every window has a fifth row to beat;
the second reads all blocks that the bounds leave.  Windows travel to blocks in packs, by equi-joins on the range of blocks and then on the block;
neither the zone maps nor the windows are broadcast.  Only a summary of at most :data:`MAX_PAGES` ranges passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

BLOCK_ROWS, ZONES, PACK = 512, 256, 128
PAGE_ROWS, MAX_PAGES = 4096, 1024
BITS = 2
TOP, SEEDS = 5, 2
#: Products of scores that a window allows: LEAST * positive <= 100 * negative <= 100 * positive.
LEAST = 80
#: Components are held within this, so that sums of products are longs; x would have to exceed a million.
GREATEST = 1 << 28
_LOW, _HIGH = -(1 << 62), 1 << 62


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where every sum is below 2 ** 53, else in longs."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of a with any point between low and high, for each of their rows."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def hilbert_keys(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row on the Hilbert curve, as bytes in big-endian order. levels: rows x dimensions, each below 2 ** bits."""
    x = levels.T.astype(np.uint8).copy()
    n = len(x)
    for shift in range(bits - 1, 0, -1):  # undo the rotations and reflections of the coarser cells
        below = np.uint8((1 << shift) - 1)
        for i in range(n):
            set_ = (x[i] >> shift & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> shift & 1, np.uint8((1 << shift) - 1), np.uint8(0))
    x ^= turn
    planes = [(x >> shift & 1).T for shift in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1), axis=1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix; shorter ones end in zeros."""
    sizes = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), size))
    out[np.arange(size) < sizes[:, None]] = flat
    return out


def quantised(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(256 * x), -GREATEST, GREATEST).astype(np.int64)


def valid_rows(embeddings: DataFrame, scratch: Scratch) -> DataFrame:
    """vec_id, label, vector of the rows that take part; of rows with one vec_id, the one with the least label, then vector."""
    vector = F.col("embedding").cast("array<double>")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    again = scratch.keep(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"), "again")
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.label", "r.vector"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, 0))
    rows = 0
    for batch in batches:
        column = batch.column(0)
        size = max(total.shape[1], int(max(np.asarray(column.value_lengths()), default=0)))
        x = quantised(_matrix(column, size)).astype(np.float64)
        total = np.pad(total, ((0, 0), (0, size - total.shape[1]))) + [x.sum(axis=0), (x * x).sum(axis=0)]
        rows += batch.num_rows
    out = [(-1, float(rows), 0.0), *((k, float(a), float(b)) for k, (a, b) in enumerate(total.T))]
    columns = zip(*out, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.float64()), strict=True)], ["k", "a", "b"])


class Space:
    """Number of rows, dimensions, and where each dimension is cut for the curve: at its mean and two thirds of a deviation beside it."""

    def __init__(self, rows: DataFrame) -> None:
        found = {r.k: r for r in rows.select("vector").mapInArrow(_sums, "k int, a double, b double").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
        self.n = int(found.pop(-1).a) if found else 0
        self.size = len(found)
        mean = np.array([found[k].a for k in range(self.size)]) / max(self.n, 1)
        variance = np.maximum(np.array([found[k].b for k in range(self.size)]) / max(self.n, 1) - mean * mean, 0)
        self.order = np.argsort(-variance, kind="stable")
        self.cuts = mean[:, None] + np.sqrt(variance)[:, None] * np.array([-0.674, 0.0, 0.674])

    def keys(self, q: np.ndarray) -> np.ndarray:
        levels = (q[:, :, None] > self.cuts).sum(axis=2)[:, self.order]
        return hilbert_keys(levels) if self.size else np.zeros((len(q), 1), np.uint8)


def _binary(matrix: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    matrix = np.ascontiguousarray(matrix)
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _placed(space: Space):
    """vec_id, label, q, key of rows (vec_id, label, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = quantised(_matrix(batch.column(2), space.size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(q.astype(np.int32)), _binary(space.keys(q))], ["vec_id", "label", "q", "key"])

    return run


_PLACED = "vec_id long, label long, q binary, key binary"
_BLOCK = pa.schema(
    [("page", pa.int32()), ("block", pa.int64()), ("least_id", pa.int64()), ("least_label", pa.int64()), ("most_label", pa.int64()), ("low", pa.binary()), ("high", pa.binary()),
     ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("q", pa.binary())]
)
BLOCKS = "page int, block long, least_id long, least_label long, most_label long, low binary, high binary, ids array<long>, labels array<long>, q binary"


def _ints(parts: list[bytes], rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.int32).reshape(rows, -1).astype(np.int64)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows, which come in order; the task's range is the page."""
    page, at, held = TaskContext.get().partitionId(), 0, []

    def block(rows: pa.Table) -> pa.RecordBatch:
        ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
        parts = rows.column("q").to_pylist()
        q = _ints(parts, len(parts)).astype(np.int32)
        row = [page, (page << 32) + at, ids.min(), labels.min(), labels.max(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes(), ids, labels, q.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            yield block(table.slice(0, BLOCK_ROWS))
            at, held = at + 1, table.slice(BLOCK_ROWS).to_batches()
    if sum(b.num_rows for b in held):
        yield block(pa.Table.from_batches(held))


def build_blocks(rows: DataFrame, space: Space, scratch: Scratch) -> DataFrame:
    """The written blocks of rows (vec_id, label, vector)."""
    pages = min(MAX_PAGES, -(-space.n // PAGE_ROWS) or 1)
    keys = ("label", "key", "vec_id")
    placed = rows.select("vec_id", "label", "vector").mapInArrow(_placed(space), _PLACED)
    return scratch.keep(placed.repartitionByRange(pages, *keys).sortWithinPartitions(*keys).mapInArrow(_cut_blocks, BLOCKS), "blocks")


_ZONE_COLUMNS = ["block", "least_id", "least_label", "most_label", "low", "high"]
_ZONE_PACK = "page int, blocks array<long>, least_id array<long>, least_label array<long>, most_label array<long>, low binary, high binary"


def _pack_zones(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("block").to_pydict()
    lists = {name: [rows[column]] for name, column in (("blocks", "block"), ("least_id", "least_id"), ("least_label", "least_label"), ("most_label", "most_label"))}
    return pa.table({"page": pa.array(rows["page"][:1], pa.int32())} | lists | {c: [b"".join(rows[c])] for c in ("low", "high")})


def _summarise(rows: pa.Table) -> pa.Table:
    rows = rows.to_pydict()
    n = len(rows["block"])
    low, high = _ints(rows["low"], n).min(axis=0), _ints(rows["high"], n).max(axis=0)
    told = {"least_id": min(rows["least_id"]), "least_label": min(rows["least_label"]), "most_label": max(rows["most_label"])}
    return pa.table({"page": pa.array(rows["page"][:1], pa.int32())} | {k: [v] for k, v in told.items()} | {"low": [low.astype(np.int32).tobytes()], "high": [high.astype(np.int32).tobytes()]})


class Zones:
    """Zone maps of blocks in packs, and a summary of each page: at most MAX_PAGES rows."""

    def __init__(self, blocks: DataFrame, scratch: Scratch) -> None:
        zones = blocks.select("page", *_ZONE_COLUMNS).withColumn("part", F.floor(F.pmod("block", F.lit(1 << 32)) / ZONES))
        self.packs = scratch.keep(zones.groupBy("page", "part").applyInArrow(_pack_zones, _ZONE_PACK), "zones")
        schema = "page int, least_id long, least_label long, most_label long, low binary, high binary"
        parts = zones.groupBy("page", "part").applyInArrow(_summarise, schema)
        pages = parts.withColumn("block", F.lit(0)).groupBy("page").applyInArrow(_summarise, schema).collect()
        self.pages = [p.page for p in pages]
        self.summary = {"least_id": [p.least_id for p in pages], "least_label": [p.least_label for p in pages], "most_label": [p.most_label for p in pages], "low": b"".join(p.low for p in pages), "high": b"".join(p.high for p in pages)}


#: A pack of windows; positive is null in the search of positives, where rows of the same label count. floor: score and id of the fifth row so far.
_WINDOW_LISTS = ["anchor", "positive", "label", "low_score", "high_score", "floor_score", "floor_id"]
WINDOW = "anchor long, positive long, label long, low_score long, high_score long, floor_score long, floor_id long, q binary"
_PACKED = ", ".join(f"{c} array<long>" for c in _WINDOW_LISTS) + ", q binary"
_PACKED_FIELDS = [*((c, pa.list_(pa.int64())) for c in _WINDOW_LISTS), ("q", pa.binary())]


class Windows:
    """A pack of windows as arrays."""

    def __init__(self, lists: dict[str, list], q: np.ndarray) -> None:
        self.lists, self.q = lists, q
        n = len(q)
        number = lambda c, default: np.array([default if v is None else v for v in lists[c]], dtype=np.int64).reshape(n)
        self.anchor, self.label = number("anchor", 0), number("label", 0)
        self.low, self.high = number("low_score", _LOW), number("high_score", _HIGH)
        self.floor, self.floor_id = number("floor_score", _LOW), number("floor_id", _HIGH)
        self.same = np.array([v is None for v in lists["positive"]]).reshape(n)

    @classmethod
    def read(cls, row: dict) -> Windows:
        return cls({c: row[c] for c in _WINDOW_LISTS}, _ints([row["q"]], len(row["anchor"])))

    def row(self, which: np.ndarray) -> tuple:
        return (*([self.lists[c][k] for k in which] for c in _WINDOW_LISTS), self.q[which].astype(np.int32).tobytes())

    def may_meet(self, zones: dict) -> tuple[np.ndarray, np.ndarray]:
        """Windows x zones: whether the zone's rows can be among the window's first ones; and the score in the middle of its bounds."""
        n = len(zones["least_id"])
        least, most = bounds(self.q, _ints([zones["low"]], n), _ints([zones["high"]], n))
        first, last, ids = (np.array(zones[c], dtype=np.int64)[None, :] for c in ("least_label", "most_label", "least_id"))
        label = self.label[:, None]
        holds = np.where(self.same[:, None], (first <= label) & (label <= last), (first != label) | (last != label))
        better = (most > self.floor[:, None]) | (most == self.floor[:, None]) & (ids <= self.floor_id[:, None])
        return holds & better & (most >= self.low[:, None]) & (least <= self.high[:, None]), np.minimum(least // 2 + most // 2, self.high[:, None])


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _pack_windows(pages: list[int], summary: dict):
    """Packs of a task's windows, each once for every page that one of them may have to read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                rows = batch.slice(start, PACK).to_pydict()
                pack = Windows({c: rows[c] for c in _WINDOW_LISTS}, _ints(rows["q"], len(rows["q"])))
                met, _ = pack.may_meet(summary)
                out = [(pages[k], *pack.row(np.flatnonzero(met[:, k]))) for k in np.flatnonzero(met.any(axis=0))]
                yield _batch(out, [("page", pa.int32()), *_PACKED_FIELDS])

    return run


def _choose(seeds: int | None):
    """Blocks that packs of windows read, by the zone maps: all that the bounds leave, or each window's few most promising ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pack = Windows.read(row)
                met, middle = pack.may_meet({"low": row["z_low"], "high": row["z_high"], "least_id": row["z_least_id"], "least_label": row["least_label"], "most_label": row["most_label"]})
                if seeds is not None:
                    order = np.argsort(np.where(met, -middle, _HIGH), axis=1, kind="stable")[:, :seeds]
                    few = np.zeros_like(met)
                    np.put_along_axis(few, order, True, axis=1)
                    met &= few
                out = [(row["blocks"][k], *pack.row(np.flatnonzero(met[:, k]))) for k in np.flatnonzero(met.any(axis=0))]
                yield _batch(out, [("block", pa.int64()), *_PACKED_FIELDS])

    return run


_FOUND = [("anchor", pa.int64()), ("positive", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of a block for each window that reads it."""
    for batch in batches:
        for row in batch.to_pylist():
            pack, ids, labels = Windows.read(row), np.array(row["ids"]), np.array(row["labels"])
            scores = product(pack.q, _ints([row["b_q"]], len(ids)))
            fits = (labels[None, :] == pack.label[:, None]) == pack.same[:, None]
            fits &= (scores >= pack.low[:, None]) & (scores <= pack.high[:, None]) & (ids[None, :] != pack.anchor[:, None])
            fits &= (scores > pack.floor[:, None]) | (scores == pack.floor[:, None]) & (ids[None, :] <= pack.floor_id[:, None])
            window, place = np.nonzero(fits)
            score, found = scores[window, place], ids[place]
            order = np.lexsort((found, -score, window))
            window, score, found = window[order], score[order], found[order]
            first = np.searchsorted(window, window, "left")
            top = np.flatnonzero(np.arange(len(window)) - first < TOP)
            positive = pack.lists["positive"]
            columns = [pack.anchor[window[top]], [positive[k] for k in window[top]], score[top], found[top]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FOUND, strict=True)], [n for n, _ in _FOUND])


def _first_rows(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _read(windows: DataFrame, blocks: DataFrame, zones: Zones, seeds: int | None) -> DataFrame:
    packs = windows.mapInArrow(_pack_windows(zones.pages, zones.summary), f"page int, {_PACKED}")
    maps = zones.packs.withColumnsRenamed({"low": "z_low", "high": "z_high", "least_id": "z_least_id"})
    chosen = packs.join(maps, "page").drop("page").mapInArrow(_choose(seeds), f"block long, {_PACKED}")
    held = blocks.select("block", "ids", "labels", F.col("q").alias("b_q"))
    found = chosen.join(held, "block").drop("block").mapInArrow(_score, "anchor long, positive long, score long, vec_id long")
    return _first_rows(found)


def search(windows: DataFrame, blocks: DataFrame, zones: Zones, scratch: Scratch) -> DataFrame:
    """anchor, positive, score, vec_id, rank: the first rows of each window (columns of WINDOW)."""
    first = scratch.keep(_read(windows, blocks, zones, SEEDS), "seeds").where(F.col("rank") == TOP)
    floors = first.select(F.col("anchor").alias("a"), F.col("positive").alias("p"), "score", "vec_id")
    joined = windows.drop("floor_score", "floor_id").join(floors, (F.col("anchor") == F.col("a")) & F.col("positive").eqNullSafe(F.col("p")), "left")
    known = joined.withColumnsRenamed({"score": "floor_score", "vec_id": "floor_id"}).select(*windows.columns)
    return scratch.keep(_read(known, blocks, zones, None), "found")


def mine_hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors, the rows whose vec_id is divisible by ``every``.

    Columns read: vec_id, embedding, label; others don't matter. A row with a null in one of them, or with a null or a component that isn't finite in its
    vector, takes no part. Of rows with one vec_id, the one with the least label, then vector, takes part. Shorter vectors end in
    zeros. Components are held within 2 ** 28 after scaling. Ties go to the smaller vec_id.
    """
    scratch = Scratch(embeddings.sparkSession, "negatives")
    rows = valid_rows(embeddings, scratch)
    space = Space(rows)
    blocks = build_blocks(rows, space, scratch)
    zones = Zones(blocks, scratch)
    anchors = rows.where(F.col("vec_id") % every == 0).select("vec_id", "label", "vector").mapInArrow(_placed(space), _PLACED)
    anchors = scratch.keep(anchors.repartitionByRange("label", "key").sortWithinPartitions("label", "key"), "anchors")
    none = F.lit(None).cast("long")
    ends = {c: none for c in ("positive", "low_score", "high_score", "floor_score", "floor_id")}
    columns = [c.split()[0] for c in WINDOW.split(", ")]
    positives = search(anchors.withColumnRenamed("vec_id", "anchor").withColumns(ends).select(*columns), blocks, zones, scratch)
    pairs = positives.select("anchor", F.col("vec_id").alias("positive"), F.col("score").alias("high_score"))
    low = F.ceil(F.col("high_score") * LEAST / F.lit(100).cast("decimal(20,0)")).cast("long")
    windows = pairs.join(anchors.withColumnRenamed("vec_id", "anchor"), "anchor").withColumns({"low_score": low, "floor_score": none, "floor_id": none})
    windows = scratch.keep(windows.where("low_score <= high_score").repartitionByRange("label", "key").sortWithinPartitions("label", "key").select(*columns), "windows")
    negatives = search(windows, blocks, zones, scratch)
    told = negatives.join(pairs, ["anchor", "positive"])
    return told.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("high_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
