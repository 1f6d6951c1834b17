"""Near-duplicate detection: a chosen-path set similarity join over MinHash tokens.

A document is its set of word shingles.  Documents with the same set form a class at once; only one
representative of each class takes part in the join, so exact copies are never paired.

Each representative has ``SLOTS`` minwise tokens.  In a tree, every node chooses some slots by a hash of
its path, and a document goes on to one child per chosen slot, named by its token there: documents that
share many tokens keep meeting.  A node of at most ``LEAF_SIZE`` documents is a leaf and is compared exhaustively, and so is a
moderate one that holds so much of its parent that ``NODE_SLOTS`` children like it would have more rows than it has; other
nodes branch again, up to ``MAX_DEPTH``.  A pair at the threshold survives a tree with a probability that
:func:`trees_for` works out; independent trees repeat until no more than one pair in a million is missed.

Only components are wanted, so large groups of copies are contracted before anything branches: the members of
large nodes under the root are dealt to blocks of ``CONTRACT_ROWS``, each block gives a spanning forest of its most
similar members (one row per member at most), and the links that the full sets confirm are joined to components.  From then on
a node whose documents all are in one component is done.  One with a component that holds a quarter of it or more
(its *core*) and few others is not branched either: the others are compared with the whole node, whose core streams past
them in blocks.  Nodes of one core, or with the same first document by hash, hold much the same documents: they are compared
as one node where that makes fewer rows.  So the rows of a group stay proportional to its members.

Nodes are compared by tokens first, which loses a link with a probability under one in a million, and what
leaves a task is again a forest: each document's most similar partner of another component.  Pairs are confirmed on full
sets.  Where documents that tokens connect are still in different components, their full sets are compared
exhaustively, so every link that joins components is found.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with nothing;
rows repeated whole share one verdict; a null id is never linked to others by the join, but takes its
class's component; an empty table gives an empty result; additional columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.llm.components import components
from treelift.llm.text import LOWER_BYTES, free_name
from treelift.sources.scratch import Scratch, in_few_tasks

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
SLOTS = 64
ROOT_SLOTS = 2
NODE_SLOTS = 4
LEAF_SIZE = 256
MAX_DEPTH = 5
TARGET_MISS = 1e-6
#: Contraction: trees whose nodes are contracted, and members of a block that are compared with one another.
CONTRACT_TREES = 2
CONTRACT_ROWS = 256
#: Others of a node that its core streams past at once, blocks of them beyond which a node branches, and rows of a stream.
OTHERS = 1024
OTHER_BLOCKS = 2
STREAM_ROWS = 4096
#: Texts that a task holds apart from its batch: so many rows, and in hashing so many bytes (some 50 times as much memory).
SLICE_ROWS = 1024
BLOCK_BYTES = 500_000
#: Ids up to which a side is broadcast (16 MB); beyond, the join is shuffled.
BROADCAST_IDS = 2_000_000

_RNG = np.random.default_rng(20240131)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_A = _RNG.integers(1, 1 << 63, SLOTS, np.uint64) | np.uint64(1)
_SLOT_B = _RNG.integers(1, 1 << 63, SLOTS, np.uint64)
_WORD_A = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def trees_for(similarity: float, miss: float = TARGET_MISS) -> int:
    """Trees after which a pair of this similarity is missed with at most this probability."""
    alive = 1.0
    for _ in range(MAX_DEPTH):
        alive = 1 - (1 - similarity * alive) ** NODE_SLOTS
    alive = 1 - (1 - similarity * alive) ** ROOT_SLOTS
    return max(1, math.ceil(math.log(miss) / math.log(1 - alive)))


def token_threshold(similarity: float, miss: float = TARGET_MISS) -> int:
    """Most equal tokens that a pair of this similarity falls short of with at most this probability."""
    total = 0.0
    for k in range(SLOTS + 1):
        total += math.comb(SLOTS, k) * similarity**k * (1 - similarity) ** (SLOTS - k)
        if total > miss:
            return k
    return SLOTS


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """1, b, b², … modulo 2⁶⁴."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
    return _powers


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """For each UTF-8 text the sorted distinct hashes of its word shingles; a shorter text is one shingle."""
    joined = b" ".join([b"", *texts, b""]).translate(LOWER_BYTES)
    buffer = np.frombuffer(joined, np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    # hash of a word: sum of value(byte) * base^(end - position), from sums over the whole buffer
    n = len(buffer)
    power = _power_table(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[buffer] * power[n - 1 :: -1][:n], dtype=np.uint64)])
    # (sums[stop] - sums[start]) is the hash times base^(n - stop); bring all to one exponent per word
    raw = sums[stops] - sums[starts]
    hashes = mix(raw * _inverse_power(n - stops) ^ (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]) if len(texts) else np.zeros(0, np.int64), side="left")
    last = np.append(first[1:], len(starts)) if len(texts) else first
    full = None
    if len(hashes) >= words:
        m = len(hashes) - words + 1
        full = np.zeros(m, np.uint64)
        for j in range(words):
            full += hashes[j : j + m] * _WORD_A[j]
        full = mix(full)
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(hashes[a:b] * _WORD_A[: b - a], dtype=np.uint64)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def _inverse_power(exponents: np.ndarray) -> np.ndarray:
    global _inverses
    top = int(exponents.max()) + 1 if len(exponents) else 1
    if len(_inverses) < top:
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(top, _INVERSE)]), dtype=np.uint64)
    return _inverses[exponents]


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets, one row of SLOTS 32-bit values each."""
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < len(sets):
        stop, rows = at, 0
        while stop < len(sets) and (stop == at or rows + len(sets[stop]) <= 16_384):
            rows += len(sets[stop])
            stop += 1
        if stop == at + 1:
            for k in range(0, len(sets[at]), 16_384):
                part = (sets[at][k : k + 16_384, None] * _SLOT_A + _SLOT_B).min(0)
                np.minimum(out[at], part, out=out[at])
        else:
            values = np.concatenate(sets[at:stop])[:, None] * _SLOT_A + _SLOT_B
            begin = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
            out[at:stop] = np.minimum.reduceat(values, begin, axis=0)
        at = stop
    return (out >> np.uint64(32)).astype(np.uint32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < BLOCK_BYTES):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts):
                sets = shingle_sets(texts[a:b], words)
                full = [s for s in sets if len(s)]
                tokens = iter(minwise(full))
                one, two = [], []
                for s in sets:
                    one.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                    two.append(int(mix(s ^ _BASE).sum(dtype=np.uint64).astype(np.int64)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(one, pa.int64()),
                        pa.array(two, pa.int64()),
                        pa.array([next(tokens).tobytes() if len(s) else None for s in sets], pa.binary()),
                        batch.column(2).slice(a, b - a),
                    ],
                    ["doc_id", "n_shingles", "key1", "key2", "tokens", "text_key"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for a, b in _blocks(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[a:b], words)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    ["rep", "shingles"],
                )

    return run


def _token_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), SLOTS)


def _children(nodes: np.ndarray, tokens: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Names of the children that rows of tokens go to, by the slots chosen for each."""
    values = np.take_along_axis(tokens, chosen, 1).astype(np.uint64)
    return mix(nodes[:, None] * _SLOT_A[0] + mix(values * _SLOT_A[1] + chosen.astype(np.uint64)))


def _roots(trees: int):
    """The root's children in every tree. Roots choose distinct slots, as long as there are any."""
    order = np.random.default_rng(7).permutation(SLOTS)
    slots = np.resize(order, trees * ROOT_SLOTS)
    names = mix(np.repeat(np.arange(1, trees + 1), ROOT_SLOTS).astype(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _token_rows(batch.column(1))
            n = len(tokens)
            for k, (slot, name) in enumerate(zip(slots, names, strict=True)):
                nodes = _children(np.full(n, name), tokens, np.full((n, 1), slot))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[:, 0].view(np.int64)), batch.column(0), pa.array(np.full(n, k // ROOT_SLOTS, np.int32))],
                    ["node", "rep", "tree"],
                )

    return run


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (node, rep, component, tokens, size) to the children in the slots that the node chooses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column(0).to_numpy().view(np.uint64)
        tokens = _token_rows(batch.column(3))
        # NODE_SLOTS distinct slots: a start and an odd step, both from the node's name
        seed = mix(nodes ^ _BASE)
        step = ((seed >> np.uint64(8)) % np.uint64(SLOTS // 2)) * np.uint64(2) + np.uint64(1)
        chosen = (seed[:, None] + np.arange(NODE_SLOTS, dtype=np.uint64) * step[:, None]) % np.uint64(SLOTS)
        names = _children(nodes, tokens, chosen.astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names.reshape(-1).view(np.int64)),
                pa.array(np.repeat(batch.column(1).to_numpy(), NODE_SLOTS)),
                pa.array(np.repeat(batch.column(2).to_numpy(), NODE_SLOTS)),
                pa.array(np.repeat(batch.column(4).to_numpy(), NODE_SLOTS)),
            ],
            ["node", "rep", "component", "parent"],
        )


def _distinct_nodes(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes of the same documents count once."""
    same = ["size", "low", "high", "mark"]
    return nodes.groupBy(*same).agg(F.min(F.struct("node", *more)).alias("at")).select("at.*", "size")


def _root_nodes(members: DataFrame) -> DataFrame:
    """Nodes of several documents, with their size."""
    nodes = members.groupBy("node").agg(
        F.count("*").alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"), F.bit_xor(F.xxhash64("rep")).alias("mark")
    )
    return _distinct_nodes(nodes.where("size > 1"))


def _mixed_nodes(members: DataFrame) -> DataFrame:
    """Nodes with documents of several components: size, core (their largest component), how many are not in it, first document by hash."""
    shares = members.groupBy("node", "component").agg(
        F.count("*").alias("n"),
        F.min("rep").alias("low"),
        F.max("rep").alias("high"),
        F.bit_xor(F.xxhash64("rep")).alias("mark"),
        F.max("parent").alias("parent"),
        F.min(F.struct(F.xxhash64("rep"), "rep")).alias("first"),
    )
    nodes = shares.groupBy("node").agg(
        F.sum("n").alias("size"),
        F.max(F.struct("n", "component")).alias("core"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.bit_xor("mark").alias("mark"),
        F.max("parent").alias("parent"),
        F.min("first").alias("first"),
    )
    nodes = nodes.where("core.n < size").withColumns({"others": F.col("size") - F.col("core.n"), "core": F.col("core.component"), "first": F.col("first.rep")})
    return _distinct_nodes(nodes, "core", "others", "parent", "first")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their document: itself, where it has no link yet."""
    if labels is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _placed(members: DataFrame, last: bool, leaf_size: int, rows: int) -> DataFrame:
    """Members of mixed nodes: whether the node is compared now, who belongs to its others, in how many blocks these are, and
    what nodes of much the same documents have in common: their core, or else their first document by hash."""
    nodes = in_few_tasks(_mixed_nodes(members), rows)
    dense = (NODE_SLOTS * F.col("size") > F.col("parent")) & (F.col("size") <= OTHERS * OTHER_BLOCKS)
    cored = (4 * F.col("others") <= 3 * F.col("size")) & (F.col("others") <= OTHERS * OTHER_BLOCKS)
    blocks = F.ceil(F.when(cored, F.col("others")).otherwise(F.col("size")) / OTHERS).cast("int")
    now = cored | dense | (F.col("size") <= leaf_size) | F.lit(last)
    joined = members.drop("parent").join(nodes, "node")
    other = ~cored | (F.col("component") != F.col("core"))
    key = F.when(cored, F.col("core")).otherwise(F.col("first"))
    placed = joined.select(
        "node", "size", "rep", "component", now.alias("now"), other.alias("other"), blocks.alias("blocks"), cored.alias("cored"), key.alias("key")
    )
    return in_few_tasks(placed, rows)


def _whole(parted: DataFrame) -> DataFrame:
    """Keys of nodes to branch that make few more rows if they are compared as one: branching takes their rows twice at least."""
    members = parted.groupBy("key", "rep").agg(F.count("*").alias("n"))
    nodes = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    blocks = F.ceil(F.col("size") / OTHERS)
    return nodes.where(F.col("size") * (F.ceil(F.col("size") / STREAM_ROWS) + (blocks - 1) / 2) <= 2 * F.col("n")).select("key")


def _merged(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of the nodes to compare: those with the same core, or the same first document, are one node where that makes fewer rows.

    So a document is compared with a group once, and not in each node where they meet.  A merged node holds every pair of its nodes.
    """
    size, others = F.col("size"), F.col("others")
    made = F.when(F.col("other"), F.ceil(size / STREAM_ROWS) + F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.col("blocks"))
    members = rows.groupBy("cored", "key", "rep").agg(
        F.first("component").alias("component"), F.first("other").alias("other"), F.sum(made).alias("made")
    )
    members = scratch.keep(members, "merged")
    nodes = members.groupBy("cored", "key").agg(F.count("*").alias("size"), F.count_if("other").alias("others"), F.sum("made").alias("made"))
    nodes = nodes.withColumn("blocks", F.ceil(others / OTHERS).cast("int"))
    fewer = (size - others) * F.col("blocks") + others * (F.ceil(size / STREAM_ROWS) + (F.col("blocks") - 1) / 2) < F.col("made")
    nodes = scratch.keep(nodes.where(fewer).select("cored", "key", F.xxhash64("cored", "key").alias("node"), "size", "blocks"), "nodes")
    columns = ["node", "size", "rep", "component", "other", "blocks"]
    whole = members.join(nodes, ["cored", "key"]).select(*columns)
    return whole.unionByName(rows.join(nodes, ["cored", "key"], "left_anti").select(*columns))


def _compared_groups(rows: DataFrame) -> DataFrame:
    """Members once for each group (node, i, s) they are part of: block i of the others meets part s of the stream."""
    parts = F.ceil(F.col("size") / STREAM_ROWS).cast("int")
    place = F.xxhash64("rep")
    own, part = F.pmod(place, F.col("blocks")).cast("int"), F.pmod(F.shiftright(place, 20), parts).cast("int")
    held = F.transform(F.sequence(F.lit(0), parts - 1), lambda s: F.struct(own.alias("i"), s.alias("s"), F.lit(True).alias("held")))
    before = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: ~F.col("other") | (i < own))
    passing = F.transform(before, lambda i: F.struct(i.alias("i"), part.alias("s"), F.lit(False).alias("held")))
    at = F.explode(F.when(F.col("other"), F.concat(held, passing)).otherwise(passing)).alias("at")
    return rows.select("node", "rep", "component", at).select("node", "at.i", "at.s", "at.held", "rep", "component")


def _runs_of(batches: Iterator[pa.RecordBatch], n_keys: int, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows sorted by their first columns, of about so many rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(k).to_numpy() for k in range(n_keys)]
        edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0))
        if len(edge):
            cut = int(edge[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            count = table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _groups_of(table: pa.Table, n_keys: int) -> Iterator[tuple[int, int]]:
    keys = [table.column(k).to_numpy() for k in range(n_keys)]
    edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], 0)) + 1
    yield from zip([0, *edge.tolist()], [*edge.tolist(), table.num_rows], strict=True)


def _forest(tokens: np.ndarray, components: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Greatest spanning forest of the pairs with enough equal tokens and different components."""
    n = len(tokens)
    waiting = np.ones(n, bool)
    best, by = np.zeros(n, np.int64), np.full(n, -1)
    links = []
    for start in range(n):
        if not waiting[start]:
            continue
        k = start
        while True:
            joined = np.flatnonzero(waiting & (components == components[k]))
            waiting[joined] = False
            for j in joined.tolist():
                same = (tokens == tokens[j]).sum(1)
                nearer = waiting & (same > best) & (same >= threshold)
                best[nearer], by[nearer] = same[nearer], j
            near = np.where(waiting, best, -1)
            k = int(near.argmax())
            if near[k] < threshold:
                break
            links.append((k, int(by[k])))
        best[waiting] = 0
    return links


def _contract(threshold: int):
    """(node, block, rep, tokens) in order to candidate links, a forest of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, 2):
            reps = table.column(2).to_numpy()
            tokens = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint32).reshape(-1, SLOTS)
            links = []
            for a, b in _groups_of(table, 2):
                links += [(a + x, a + y) for x, y in _forest(tokens[a:b], np.arange(b - a), threshold)]
            if links:
                x, y = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(reps[x], reps[y])), pa.array(np.maximum(reps[x], reps[y]))], ["a", "b"])

    return run


def _compare_tokens(threshold: int):
    """(node, i, s, held, rep, component, tokens) in order to (node, i, s, held, rep, link).

    A row per document that tokens connect to one of another component; link names the partner to confirm, if any.
    """

    def solve(held: np.ndarray, components: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        near = np.zeros(len(held), bool)
        here = np.flatnonzero(held)
        best, by = np.zeros(len(here), np.int64), np.full(len(here), -1)
        for k in range(len(held)):
            same = (tokens[here] == tokens[k]).sum(1)
            same[components[here] == components[k]] = 0
            close = same >= threshold
            if close.any():
                near[k] = True
                near[here[close]] = True
                if not held[k]:
                    closer = close & (same > best)
                    best[closer], by[closer] = same[closer], k
        links = [(here[x], here[y]) for x, y in _forest(tokens[here], components[here], threshold)]
        return near, links + [(here[k], by[k]) for k in np.flatnonzero(by >= 0)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs_of(batches, 3):
            place = [table.column(k).to_numpy() for k in range(3)]
            held, reps, components = (table.column(k).to_numpy() for k in (3, 4, 5))
            tokens = np.frombuffer(b"".join(table.column(6).to_pylist()), np.uint32).reshape(-1, SLOTS)
            rows, partner = [], []
            for a, b in _groups_of(table, 3):
                near, links = solve(held[a:b], components[a:b], tokens[a:b])
                found = a + np.flatnonzero(near)
                rows += [*found.tolist(), *(a + int(x) for x, _ in links)]
                partner += [*reps[found].tolist(), *(int(reps[a + y]) for _, y in links)]
            if rows:
                at = np.array(rows)
                columns = [*(c[at] for c in place), held[at], reps[at], np.array(partner, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "i", "s", "held", "rep", "link"])

    return run


class _Held:
    """The held documents of one group: their sets as an index, and the components that links have joined."""

    def __init__(self, percent: int) -> None:
        self.percent, self.reps, self.components, self.sets = percent, [], [], []
        self.root: dict[int, int] = {}
        self.values: np.ndarray | None = None

    def find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def hold(self, rep: int, component: int, shingles: np.ndarray) -> None:
        self.reps.append(rep)
        self.components.append(component)
        self.sets.append(shingles)

    def index(self) -> None:
        self.size = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(self.sets)), self.size)[order]
        self.values, self.begin = np.unique(flat[order], return_index=True)
        self.stop = np.append(self.begin[1:], len(flat))

    def links(self, rep: int, component: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """Links of a document to held ones of other components, as far as they join them."""
        if not self.sets:
            return []
        if self.values is None:
            self.index()
        at = np.minimum(np.searchsorted(self.values, shingles), len(self.values) - 1)
        at = at[self.values[at] == shingles]
        if not len(at):
            return []
        both = np.bincount(np.concatenate([self.owner[self.begin[v] : self.stop[v]] for v in at.tolist()]), minlength=len(self.sets))
        out = []
        for j in np.flatnonzero(100 * both >= self.percent * (self.size + len(shingles) - both)).tolist():
            x, y = self.find(component), self.find(self.components[j])
            if x != y:
                self.root[x] = y
                out.append((rep, self.reps[j]))
        return out


def _compare_sets(percent: int):
    """(node, i, s, held, rep, component, shingles), held ones first, to links (a, b) that join different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, _Held(percent)
        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            held, reps, comps = (batch.column(k).to_pylist() for k in (3, 4, 5))
            column = batch.column(6)
            flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            links: list[tuple[int, int]] = []
            for k, at in enumerate(place):
                shingles = flat[offsets[k] : offsets[k + 1]]
                if at != key:
                    if group.reps:
                        links += _among(group)
                    key, group = at, _Held(percent)
                if held[k]:
                    group.hold(reps[k], comps[k], shingles.copy())
                else:
                    links += group.links(reps[k], comps[k], shingles)
            if links:
                yield _pairs(links)
        if group.reps and (links := _among(group)):
            yield _pairs(links)

    return run


def _among(group: _Held) -> list[tuple[int, int]]:
    """Links among the held documents of a group."""
    return [link for row in zip(group.reps, group.components, group.sets, strict=True) for link in group.links(*row)]


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])


def _set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """Full shingle sets of the documents named; their ids are broadcast only while they are few."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.join(ids, docs["doc_id"] == ids["rep"], "left_semi").select("doc_id", "text")
    return rows.mapInArrow(_sets(words), "rep long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    enough: Column = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def _contracted(level: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Candidate links (a, b) within blocks of the large nodes. level: node, size, rep."""
    blocks = F.ceil(F.col("size") / CONTRACT_ROWS)
    dealt = level.select("node", F.pmod(F.xxhash64("rep", F.lit(CONTRACT_ROWS)), blocks).cast("int").alias("block"), "rep").join(reps, "rep")
    dealt = dealt.select("node", "block", "rep", "tokens").repartition(_parts(level), "node", "block").sortWithinPartitions("node", "block")
    return dealt.mapInArrow(_contract(SLOTS * percent * 9 // 1000), "a long, b long").distinct()


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()


class _Links:
    """Confirmed links so far, and the components they make."""

    def __init__(self, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> None:
        self.docs, self.words, self.percent, self.scratch = docs, words, percent, scratch
        self.tables: list[DataFrame] = []
        self.labels: DataFrame | None = None

    def add(self, links: DataFrame) -> None:
        self.tables.append(links)
        joined = components(reduce(DataFrame.unionByName, self.tables), self.scratch)
        self.labels = joined.select(F.col("node").alias("rep"), "component")

    def confirm(self, candidates: DataFrame) -> None:
        candidates = self.scratch.keep(candidates, "candidates")
        sets = self.scratch.keep(_set_table(self.docs, _ends(candidates), self.words), "sets")
        self.add(self.scratch.keep(confirm(candidates, sets, self.percent), "links"))
        self.scratch.drop(candidates, sets)


def _leaves(reps: DataFrame, trees: int, links: _Links, leaf_size: int) -> DataFrame:
    """Members of the nodes to compare (node, size, rep, component, other, blocks), of all trees and depths."""
    scratch = links.scratch
    roots = reps.select("rep", "tokens").mapInArrow(_roots(trees), "node long, rep long, tree int")
    level = scratch.keep(roots.join(_root_nodes(roots), "node").select("node", "size", "rep", "tree"), "level")
    sizes = level.agg(F.count("*").alias("all"), F.count_if(F.col("size") > leaf_size).alias("large")).first()
    if sizes.large:
        large = level.where((F.col("size") > leaf_size) & (F.col("tree") < CONTRACT_TREES))
        links.confirm(_contracted(large, reps, links.percent))
    members = scratch.keep(_labelled(level.select("node", "rep"), links.labels), "members").withColumn("parent", F.lit(1 << 62))
    rows, found = sizes.all, []
    for depth in range(MAX_DEPTH + 1):
        placed = scratch.keep(_placed(members, depth == MAX_DEPTH, leaf_size, rows), f"placed{depth}")
        found.append(placed.where("now").drop("now"))
        parted = placed.where("not now")
        whole = scratch.keep(_whole(parted), f"whole{depth}")
        found.append(parted.join(whole, "key", "left_semi").select(*found[-1].columns))
        parted = scratch.keep(parted.join(whole, "key", "left_anti"), f"branching{depth}")
        rows = NODE_SLOTS * parted.count()
        if not rows:
            break
        parted = parted.join(reps, "rep").select("node", "rep", "component", "tokens", "size")
        parted = scratch.keep(parted, f"parted{depth}")
        members = parted.mapInArrow(_branch, "node long, rep long, component long, parent long")
    return _merged(reduce(DataFrame.unionByName, found), scratch)


def near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT, leaf_size: int = LEAF_SIZE
) -> DataFrame:
    """One row per document: size of its set, smallest id of its component, and whether it is the one kept."""
    return _verdicts(docs, words, percent, leaf_size).select("doc_id", "n_shingles", "component_id", "kept")


def _verdicts(docs: DataFrame, words: int, percent: int, leaf_size: int = LEAF_SIZE) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_key"))
    trees, threshold = trees_for(percent / 100), token_threshold(percent / 100)

    sketches = scratch.keep(
        docs.mapInArrow(_sketch(words), "doc_id long, n_shingles long, key1 long, key2 long, tokens binary, text_key long"), "sketches"
    )
    keys = ["key1", "key2", "n_shingles"]
    classes = scratch.keep(
        sketches.where("n_shingles > 0").groupBy(*keys).agg(
            F.min("doc_id").alias("rep"), F.first("tokens").alias("tokens"), F.min("text_key").alias("first_key")
        ),
        "classes",
    )
    reps = classes.where("rep is not null").select("rep", "tokens")
    links = _Links(docs, words, percent, scratch)
    groups = _compared_groups(_leaves(reps, trees, links, leaf_size))

    # similar by their tokens
    place = ["node", "i", "s"]
    rows = groups.join(reps, "rep").select(*place, "held", "rep", "component", "tokens")
    rows = rows.repartition(_parts(docs), *place).sortWithinPartitions(*place)
    near = scratch.keep(
        rows.mapInArrow(_compare_tokens(threshold), "node long, i int, s int, held boolean, rep long, link long"), "near"
    )
    links.confirm(near.where("rep <> link").select(F.least("rep", "link").alias("a"), F.greatest("rep", "link").alias("b")).distinct())

    # groups that are still in several components: their full sets
    marked = scratch.keep(_labelled(near.select(*place, "held", "rep").distinct(), links.labels), "marked")
    split = (
        marked.groupBy(*place)
        .agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"), F.bit_xor(F.xxhash64("rep", "held")).alias("mark"))
        .where("x < y")
        .groupBy("n", "mark", "x", "y")
        .agg(F.min(F.struct(*place)).alias("at"))
        .select("at.*")
    )
    rows = scratch.keep(marked.join(split, place), "split")
    if not rows.isEmpty():
        sets = _set_table(docs, rows.select("rep").distinct(), words)
        rows = rows.join(sets, "rep").select(*place, "held", "rep", "component", "shingles")
        rows = rows.repartition(_parts(docs), *place).sortWithinPartitions(*place, F.desc("held"))
        more = scratch.keep(rows.mapInArrow(_compare_sets(percent), "a long, b long"), "more")
        if not more.isEmpty():
            links.add(more)

    placed = classes.join(links.labels, "rep", "left").select(*keys, "first_key", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", "text_key", *keys).join(placed, keys, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", "first_key", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """One document of each component, with all its columns.

    Of rows that share id and text one stays; of texts without an id that have the same set one stays, if none with an id has it.
    """
    verdicts = _verdicts(docs, words, percent).where(
        "kept and (doc_id is not null or n_shingles = 0 or text_key = first_key)"
    )
    ident, key, rows = (free_name(docs, n) for n in ("id", "key", "rows"))
    kept = verdicts.groupBy(F.col("doc_id").alias(ident), F.col("text_key").alias(key)).agg(F.count("*").alias(rows))
    kept = Scratch(docs.sparkSession, "kept").keep(kept, "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(kept[ident]) & (F.xxhash64(docs["text"]) == kept[key])
    once = docs.join(kept.where(f"{rows} = 1"), same, "left_semi")
    again = docs.join(kept.where(f"{rows} > 1"), same).dropDuplicates([ident, key]).select(*(F.col(f"`{c}`") for c in docs.columns))
    return once.unionByName(again)
