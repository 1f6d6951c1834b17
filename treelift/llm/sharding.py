"""Sharding by a minimax contiguous partition.

Documents with equal texts form one atomic group.  Groups are ordered by the SHA-256 of their text, and
the smallest capacity is sought for which that order can be cut into ``shards`` contiguous pieces of at
most that many bytes.  A capacity is checked greedily: from each cut, go as far as the capacity allows.

The order is never gathered.  The driver holds prefix sums of 4,096 ranges of the order (by the leading
digits of the digest); a greedy check then knows each cut to within one range, which brackets the
capacity.  Only ranges in which a cut can still lie are split into 256 each, by one aggregation over the
table of groups, until the ranges that matter hold one group.  What the driver holds depends on the number
of shards, not on the number of documents.

Positions inside a shard come from prefix sums over fixed salts of each group, so a text that makes up a
third of the corpus is numbered by 64 tasks.

Defined results: a null text has no bytes and equals the empty text; every row counts, repeated ones too;
an empty table gives an empty result; with fewer groups than shards the last shards stay empty; additional
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

SHARDS = 24
ROW_OVERHEAD = 8
SALTS = 64
COARSE_DIGITS = 3
FINE_DIGITS = 2


class Ranges:
    """Prefix sums over ranges of the order. A range is (leading digits, bytes, number of groups)."""

    def __init__(self, ranges: list[tuple[str, int, int]]) -> None:
        self.ranges = sorted(ranges)
        self.ends = []
        total = 0
        for _, size, _ in self.ranges:
            total += size
            self.ends.append(total)
        self.total = total
        self.starts = [0, *self.ends[:-1]]

    def below(self, x: int) -> int:
        """Number of whole ranges that end at or before x."""
        return bisect_right(self.ends, x)

    def greedy(self, capacity: int, shards: int, hopeful: bool) -> tuple[bool, set[int], list[int]]:
        """Whether the cuts reach the end; ranges of several groups that a cut falls into; whole ranges before each cut.

        In such a range the true cut is unknown: ``hopeful`` takes all that the capacity allows, else the range's start.
        """
        at, open_ranges, cuts = 0, set(), []
        for _ in range(shards):
            k = self.below(at + capacity)
            if k == len(self.ranges):
                return True, open_ranges, cuts
            cuts.append(k)
            if self.ranges[k][2] > 1:
                open_ranges.add(k)
                at = at + capacity if hopeful else max(at, self.starts[k])
            else:
                at = max(at, self.starts[k])
        return False, open_ranges, cuts

    def smallest(self, shards: int, hopeful: bool) -> int:
        low, high = 0, max(1, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards, hopeful)[0]:
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self, shards: int) -> set[int]:
        """Ranges that have to be split before the smallest capacity and its cuts are known."""
        low, high = self.smallest(shards, True), self.smallest(shards, False)
        known = self.greedy(low, shards, False)
        if low == high and not known[1]:
            return set()
        # between the earliest and the latest place that each cut can take
        early, late = self.greedy(low, shards, False)[2], self.greedy(high, shards, True)[2]
        found = {k for cut in (early, late) for k in cut if self.ranges[k][2] > 1}
        late += [len(self.ranges) - 1] * (len(early) - len(late))
        for a, b in zip(early, late, strict=False):
            found.update(k for k in range(min(a, b), max(a, b) + 1) if self.ranges[k][2] > 1)
        return found


def _prefix(digits: int) -> Column:
    return F.substring("key", 1, digits)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Smallest capacity and, for each shard but the last, the leading digits of the last group it takes.

    ``groups``: key (upper-case hex digest), bytes.
    """

    def summed(df: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        rows = df.groupBy(_prefix(digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return [(r.p, r.b, r.n) for r in rows]

    state = Ranges(summed(groups, COARSE_DIGITS))
    while todo := state.undecided(shards):
        widths: dict[int, list[str]] = {}
        for k in todo:
            widths.setdefault(len(state.ranges[k][0]), []).append(state.ranges[k][0])
        kept = [r for k, r in enumerate(state.ranges) if k not in todo]
        for width, prefixes in widths.items():
            kept += summed(groups.where(_prefix(width).isin(prefixes)), width + FINE_DIGITS)
        state = Ranges(kept)
    capacity = state.smallest(shards, False)
    cuts = state.greedy(capacity, shards, False)[2]
    return capacity, [state.ranges[k - 1][0] if k else "" for k in cuts]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: size, checksum, shard, and its place in the shard."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    ).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    in_salt = Window.partitionBy("digest", "salt").orderBy("doc_id")
    numbered = scratch.keep(rows.withColumn("rank", F.row_number().over(in_salt) - 1), "numbered")
    parts = scratch.keep(
        numbered.groupBy("digest", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "parts"
    )
    groups = scratch.keep(
        parts.groupBy("digest").agg(F.sum("bytes").alias("bytes")).select(F.hex("digest").alias("key"), "bytes"), "groups"
    )
    _, cuts = minimax_cuts(groups, shards)

    key = F.hex("digest")
    shard = F.lit(0)
    for last in cuts:
        shard = shard + (key > last.ljust(64, "F") if last else F.lit(True)).cast("int")
    placed = parts.select("digest", "salt", "n", F.least(shard, F.lit(shards - 1)).alias("shard"), F.substring(key, 1, COARSE_DIGITS).alias("range"))
    ranges = placed.groupBy("shard", "range").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "range").orderBy("digest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, ["shard", "range"])
        .select("digest", "salt", "shard", (F.col("start") + F.col("inner")).alias("offset"))
    )
    return numbered.join(offsets, ["digest", "salt"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
