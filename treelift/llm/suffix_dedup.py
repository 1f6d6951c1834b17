"""Removal of long repeated byte strings, judged over the whole corpus.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts anywhere else.  Sorting all suffixes of a
corpus column by column takes as many passes as its longest document has bytes, so the sort is confined to
where it can matter:

1. In every run of LENGTH - GRAM + 1 neighbouring grams of 32 bytes, the one with the smallest hash is an
   *anchor*.  Equal strings have equal anchors at equal places, so a repeated string shows as an anchor
   that occurs twice.  Only anchors are shuffled, one for about 185 bytes.
2. Each anchor comes with a hash of its whole neighbourhood, all bytes that a string over it could
   cover.  Occurrences with the same neighbourhood repeat all of it and need no more work, which is how exact
   copies and popular passages of any number are settled by one aggregation.
3. The different neighbourhoods of one anchor are sorted as a collection of aligned segments: from the right,
   each round inserts one symbol per segment, which updates the order of all segments (the collection's
   Burrows-Wheeler order) and the common prefixes of neighbours in it.  In the round of a column, a
   neighbour with a common prefix of LENGTH or more means that the string which starts there is repeated.

Segments are dealt by anchor; an anchor with more than ``SORT_LIMIT`` different neighbourhoods is counted
by string hashes in an aggregation instead, so no task holds an unbounded group.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; rows repeated whole are
occurrences of each other, so their long texts go altogether; a null id stays null; an empty table gives
an empty result; additional columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

LENGTH = 400
GRAM = 32
SORT_LIMIT = 200_000
BATCH_SEGMENTS = 20_000
BLOCK_BYTES = 1_000_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = int(0x9E3779B97F4A7C15)
_LEFT_K, _RIGHT_K = (_RNG.integers(1, 1 << 63, 2, np.uint64) | np.uint64(1)).tolist()
OUTSIDE = 256


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _double(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of strings of twice the width, from those of the width."""
    return h[: len(h) - width] * _power(width) + h[width:]


def _wide(grams: np.ndarray, width: int, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of strings of any length at some places, put together from those of fixed width (a power of two)."""
    total = np.zeros(len(at), np.uint64)
    for k in range(0, length - length % width, width):
        total = total * _power(width) + grams[at + k]
    return total


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of at least ``length`` bytes: text number, place, anchor hash and neighbourhood hash of each anchor."""
    pad = b"\0" * (length + gram)
    buffer = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = len(pad) + np.cumsum(np.concatenate([[0], sizes[:-1] + len(pad)])).astype(np.int64)
    h = _BYTE[buffer]
    width = 1
    while width < gram:
        h = _double(h, width)
        width *= 2
    window = length - gram + 1
    mask = np.uint64((1 << 30) - 1)
    key = (_mix(h) & ~mask) | np.arange(len(h), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= window:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
    n_windows = sizes - length + 1
    first = np.repeat(starts - np.concatenate([[0], np.cumsum(n_windows)[:-1]]), n_windows) + np.arange(n_windows.sum())
    at = (least[first] & mask).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), n_windows)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    at, owner = at[new], owner[new]
    # neighbourhood: window - 1 bytes to the left of the anchor, length bytes from it on, cut off at the text's ends
    left = np.minimum(at - starts[owner], window - 1)
    right = np.minimum(starts[owner] + sizes[owner] - at, length)
    around = window - 1 + length
    begin = at - (window - 1)
    total = _wide(h, gram, begin, around)
    for k in range(around - around % gram, around):
        total = total * np.uint64(_BASE) + _BYTE[buffer[begin + k]]
    context = _mix(total + left.astype(np.uint64) * np.uint64(_LEFT_K) + right.astype(np.uint64) * np.uint64(_RIGHT_K))
    return owner, at - starts[owner], _mix(h[at]), context


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            long = [k for k, t in enumerate(texts) if t is not None and len(t) >= length]
            at = 0
            while at < len(long):
                stop, size = at, 0
                while stop < len(long) and (stop == at or size < BLOCK_BYTES):
                    size += len(texts[long[stop]])
                    stop += 1
                rows = pa.array(long[at:stop], pa.int64())
                owner, pos, anchor, context = anchors_of([texts[k] for k in long[at:stop]], length, gram)
                owner = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(context.view(np.int64)),
                        batch.column(0).take(rows).take(owner),
                        batch.column(1).take(rows).take(owner),
                        pa.array(pos),
                    ],
                    ["anchor", "context", "doc_id", "text_key", "pos"],
                )
                at = stop

    return run


def repeated_starts(segments: np.ndarray, groups: np.ndarray, length: int) -> np.ndarray:
    """Which strings of ``length`` symbols, by segment and first column, start in another segment of the group too.

    ``segments`` holds a symbol per column, OUTSIDE beyond a text's ends; ``groups`` numbers them in order.
    """
    n, columns = segments.shape
    found = np.zeros((n, max(0, columns - length + 1)), bool)
    order = np.arange(n)  # segments by group, then by their suffix from the current column on
    common = np.zeros(n + 1, np.int16)  # symbols in common with the neighbour before
    base = groups.astype(np.int64) * (OUTSIDE + 1)
    for column in range(columns - 1, -1, -1):
        symbol = segments[order, column].astype(np.int64)
        keys = base + symbol  # order is by group first, so groups[order] == groups
        rank = np.argsort(keys, kind="stable")
        order = order[rank]
        keys = keys[rank]
        same = np.zeros(n, bool)
        same[1:] = (keys[1:] == keys[:-1]) & (symbol[rank][1:] != OUTSIDE)
        later = np.flatnonzero(same)
        fresh = np.zeros(n + 1, np.int16)
        if len(later):
            bounds = np.empty(2 * len(later), np.int64)
            bounds[0::2] = rank[later - 1] + 1
            bounds[1::2] = rank[later] + 1
            fresh[later] = np.minimum(np.minimum.reduceat(common, bounds)[0::2] + 1, length)
        common = fresh
        if column < found.shape[1]:
            hit = common[:n] >= length
            hit[:-1] |= common[1:n] >= length
            found[order[hit], column] = True
    return found


def _segments(length: int, gram: int):
    """Texts with anchor places to one row per anchor, with its neighbourhood's bytes."""
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, marks = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            rows, anchor, pos, single, cut, size = [], [], [], [], [], 0
            for k, (text, places) in enumerate(zip(texts, marks, strict=True)):
                for m in places:
                    p = m["pos"]
                    rows.append(k)
                    anchor.append(m["anchor"])
                    pos.append(p)
                    single.append(m["single"])
                    cut.append(text[max(0, p - left) : p + length])
                    size += len(cut[-1])
                if size > 4 * BLOCK_BYTES or k == len(texts) - 1:
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor, pa.int64()),
                            ids.take(take),
                            keys.take(take),
                            pa.array(pos, pa.int64()),
                            pa.array(single, pa.bool_()),
                            pa.array(cut, pa.binary()),
                        ],
                        ["anchor", "doc_id", "text_key", "pos", "single", "bytes"],
                    )
                    rows, anchor, pos, single, cut, size = [], [], [], [], [], 0

    return run


def _symbols(cut: list[bytes], pos: list[int], length: int, gram: int) -> np.ndarray:
    left = length - gram
    out = np.full((len(cut), left + length), OUTSIDE, np.int16)
    for k, (b, p) in enumerate(zip(cut, pos, strict=True)):
        begin = max(0, left - p)
        out[k, begin : begin + len(b)] = np.frombuffer(b, np.uint8)
    return out


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, first and last columns of the runs of True."""
    padded = np.zeros((len(found), found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    rows, begin = np.nonzero(change == 1)
    _, end = np.nonzero(change == -1)
    return rows, begin, end - 1


_SPANS = "doc_id long, text_key long, start long, stop long"


def _compare(length: int, gram: int):
    """Segments in order of their anchor to spans of repeated bytes; many anchors are sorted at once."""
    left = length - gram

    def solve(part: list[tuple]) -> pa.RecordBatch:
        anchor, doc_id, key, pos, single, cut = (list(c) for c in zip(*part, strict=True))
        number = np.concatenate([[0], np.cumsum(np.diff(np.array(anchor, np.int64)) != 0)])
        found = repeated_starts(_symbols(cut, pos, length, gram), number, length)
        found[~np.array(single, bool)] = False  # their whole neighbourhood is known to be repeated
        rows, begin, end = _runs(found)
        place = np.array(pos, np.int64)[rows] - left
        take = pa.array(rows)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc_id, pa.int64()).take(take),
                pa.array(key, pa.int64()).take(take),
                pa.array(place + begin),
                pa.array(place + end + length),
            ],
            ["doc_id", "text_key", "start", "stop"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH_SEGMENTS and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return run


def _string_hashes(length: int, gram: int):
    """Segments to a row per string of ``length`` bytes inside the text: anchor, column, hash."""
    left = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, doc_id, key, pos, single, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = max(0, left - pos)
                n = len(cut) - length + 1
                if n <= 0:
                    continue
                digests = [
                    int.from_bytes(hashlib.blake2b(cut[k : k + length], digest_size=8).digest(), "little", signed=True) for k in range(n)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([anchor] * n, pa.int64()),
                        pa.array(range(begin, begin + n), pa.int64()),
                        pa.array(digests, pa.int64()),
                        pa.array([doc_id] * n, pa.int64()),
                        pa.array([key] * n, pa.int64()),
                        pa.array([pos - left + begin + k for k in range(n)], pa.int64()),
                        pa.array([single] * n, pa.bool_()),
                    ],
                    ["anchor", "col", "digest", "doc_id", "text_key", "start", "single"],
                )

    return run


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, sort_limit: int = SORT_LIMIT) -> DataFrame:
    """Byte spans (doc_id, text_key, start, stop) covered by repeated strings; they may overlap. docs: doc_id, text_key, text."""
    long = docs.where(F.octet_length("text") >= length)
    schema = "anchor long, context long, doc_id long, text_key long, pos long"
    anchors = scratch.keep(long.select("doc_id", "text_key", "text").mapInArrow(_anchor_rows(length, gram), schema), "anchors")
    busy = (
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("context").alias("x"), F.max("context").alias("y"))
        .where("n > 1")
        .select("anchor", (F.col("x") != F.col("y")).alias("varied"))
    )
    candidates = scratch.keep(anchors.join(busy, "anchor"), "candidates")
    scratch.drop(anchors)
    classes = scratch.keep(
        candidates.groupBy("anchor", "context", "varied").agg(
            F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "pos")).alias("at")
        ),
        "classes",
    )
    left = length - gram
    whole = candidates.join(classes.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(
        "doc_id", "text_key", F.greatest(F.lit(0), F.col("pos") - left).alias("start"), (F.col("pos") + length).alias("stop")
    )

    # the different neighbourhoods of an anchor, one occurrence of each
    varied = classes.where("varied").select("anchor", "at.*", (F.col("n") == 1).alias("single"))
    marks = varied.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "pos", "single")).alias("marks"))
    segments = scratch.keep(
        long.join(marks, _same_doc(long, marks))
        .select(long["doc_id"], long["text_key"], "text", "marks")
        .mapInArrow(_segments(length, gram), "anchor long, doc_id long, text_key long, pos long, single boolean, bytes binary"),
        "segments",
    )
    crowds = scratch.keep(segments.groupBy("anchor").count().where(F.col("count") > sort_limit).select("anchor"), "crowds")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_part = segments
    if not crowds.isEmpty():
        sorted_part = segments.join(crowds, "anchor", "left_anti")
    found = sorted_part.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length, gram), _SPANS)
    spans = whole.unionByName(found)
    if not crowds.isEmpty():
        strings = segments.join(crowds, "anchor", "left_semi").mapInArrow(
            _string_hashes(length, gram),
            "anchor long, col long, digest long, doc_id long, text_key long, start long, single boolean",
        )
        names = ["anchor", "col", "digest"]
        twice = strings.groupBy(*names).count().where("count > 1").select(*names)
        spans = spans.unionByName(
            strings.where("single").join(twice, names, "left_semi").select("doc_id", "text_key", "start", (F.col("start") + length).alias("stop"))
        )
    return spans


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        out = []
        for text, spans in zip(texts, batch.column(2).to_pylist(), strict=True):
            text = text or b""
            kept, at, removed, runs, last = [], 0, 0, 0, -1
            for s in sorted((s["start"], min(s["stop"], len(text))) for s in spans or []):
                if s[1] <= at and runs:
                    continue
                if s[0] > last or not runs:
                    runs += 1
                begin = max(s[0], at)
                kept.append(text[at:begin])
                removed += s[1] - begin
                at = last = s[1]
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((len(text), removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, sort_limit: int = SORT_LIMIT) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, digest of the rest, and the rest as text."""
    scratch = Scratch(docs.sparkSession, "suffix")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    spans = repeated_spans(keyed, scratch, length, gram, sort_limit)
    spans = scratch.keep(spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    joined = keyed.join(spans, _same_doc(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    return joined.mapInArrow(
        _cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
    )
