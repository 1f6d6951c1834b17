"""Exact deduplication with a sharded cuckoo filter.

Texts are equal when they are identical after lower-casing A-Z.  Each text is reduced to its SHA-256
digest on the JVM side.  A :class:`CuckooIndex` then groups digests twice: once inside every scan task,
so that a text that makes up a third of the corpus leaves each task as a single row, and once per shard
after those rows were shuffled by digest.  A filter hit is only a hint: it is verified against the
digests stored for that bucket, so false positives cost a look-up and never a document.

Defined results: a null text counts as empty; an empty table gives an empty result; rows that repeat
both id and text all carry the same verdict (``kept`` compares ids); a null id is smaller than any other
id; additional columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.llm.text import ascii_lower

SLOTS = 4
MAX_KICKS = 200
#: Live digests that one shard of the index should hold, about 100 MB with their stored keys.
DIGESTS_PER_SHARD = 400_000
#: Digests after which a scan task hands on what it has grouped so far.
COMBINE_LIMIT = 200_000
NO_ID = -(1 << 63)

_MERGED = "digest binary, max_id long, n long"


class CuckooIndex:
    """Cuckoo filter over live digests, with the digests themselves stored beside it.

    The filter holds 16-bit fingerprints in buckets of four.  ``stored`` maps each live digest to
    ``[references, largest id]``; it verifies hits, allows deletion, and is what a table that has
    overflowed is rebuilt from at twice the size.
    """

    def __init__(self, capacity: int = 1 << 12) -> None:
        self.stored: dict[bytes, list[int]] = {}
        self._allocate(max(8, 1 << (max(1, capacity // 3) - 1).bit_length()))

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16)

    @staticmethod
    def _spread(fingerprint: int) -> int:
        return (fingerprint * 0x5BD1E995 >> 7) & 0x7FFFFFFF

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        fingerprint = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:8], "little") & self.mask
        return fingerprint, first, (first ^ self._spread(fingerprint)) & self.mask

    def maybe(self, digests: list[bytes]) -> np.ndarray:
        """For many digests at once: whether the filter has seen each. True may be wrong, False never is."""
        if not digests:
            return np.zeros(0, bool)
        head = np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)
        fingerprint = head & np.uint64(0xFFFF)
        fingerprint[fingerprint == 0] = 1
        first = (head >> np.uint64(16)) & np.uint64(self.mask)
        spread = ((fingerprint * np.uint64(0x5BD1E995)) >> np.uint64(7)) & np.uint64(0x7FFFFFFF)
        second = (first ^ spread) & np.uint64(self.mask)
        wanted = fingerprint.astype(np.uint16)[:, None]
        return (self.table[first] == wanted).any(1) | (self.table[second] == wanted).any(1)

    def _put(self, digest: bytes) -> bool:
        fingerprint, at, other = self._place(digest)
        for bucket in (at, other):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = fingerprint
                return True
        at = other
        for kick in range(MAX_KICKS):
            slot = (kick + fingerprint) % SLOTS
            fingerprint, self.table[at, slot] = int(self.table[at, slot]), fingerprint
            at = (at ^ self._spread(fingerprint)) & self.mask
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fingerprint
                return True
        return False

    def _grow(self) -> None:
        while True:
            self._allocate(2 * (self.mask + 1))
            if all(map(self._put, self.stored)):
                return

    def insert(self, digest: bytes, row_id: int = NO_ID, references: int = 1, hit: bool = True) -> bool:
        """Adds references to a digest; True if it was live before. ``hit``: what :meth:`maybe` has said."""
        entry = self.stored.get(digest) if hit else None
        if entry is not None:
            entry[0] += references
            entry[1] = max(entry[1], row_id)
            return True
        self.stored[digest] = [references, row_id]
        if not self._put(digest):
            self._grow()
        return False

    def delete(self, digest: bytes, references: int = 1) -> bool:
        """Takes references from a live digest; at none its fingerprint leaves the filter. False if it wasn't live."""
        entry = self.stored.get(digest)
        if entry is None:
            return False
        entry[0] -= references
        if entry[0] <= 0:
            fingerprint, first, second = self._place(digest)
            for bucket in (first, second):
                slots = np.flatnonzero(self.table[bucket] == fingerprint)
                if len(slots):
                    self.table[bucket, slots[0]] = 0
                    break
            del self.stored[digest]
        return True

    def add_batch(self, digests: list[bytes], ids: list[int], references: list[int]) -> None:
        """Inserts a batch: the filter is asked for all rows at once, rows new to it are noted as they come."""
        fresh: set[bytes] = set()
        for digest, row_id, n, hit in zip(digests, ids, references, self.maybe(digests).tolist(), strict=True):
            if not hit:
                hit = digest in fresh
                fresh.add(digest)
            self.insert(digest, row_id, n, hit)


def _drain(index: CuckooIndex) -> pa.RecordBatch:
    stored = index.stored
    ids = [e[1] for e in stored.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(stored), pa.binary()),
            pa.array([None if i == NO_ID else i for i in ids], pa.int64()),
            pa.array([e[0] for e in stored.values()], pa.int64()),
        ],
        ["digest", "max_id", "n"],
    )


def _combine(limit: int | None):
    """Groups the rows of one task by digest; with a limit, what was grouped is handed on whenever it is reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            ids = batch.column(1).fill_null(NO_ID).to_pylist()
            index.add_batch(batch.column(0).to_pylist(), ids, batch.column(2).to_pylist())
            if limit and len(index.stored) >= limit:
                yield _drain(index)
                index = CuckooIndex()
        yield _drain(index)

    return run


def shards_for(docs: DataFrame, per_shard: int = DIGESTS_PER_SHARD) -> int:
    """Shards so that each holds a bounded number of digests, whatever the table's size."""
    spark = docs.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // per_shard))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its digest, the id that stays for its text, the group's size and whether it is kept."""
    keyed = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.col(text_col)), 256)).alias("digest"),
    )
    rows = keyed.select("digest", "doc_id", F.lit(1).cast("long").alias("n"))
    grouped = (
        rows.mapInArrow(_combine(COMBINE_LIMIT), _MERGED)
        .repartition(shards_for(docs), "digest")
        .mapInArrow(_combine(None), _MERGED)
        .select("digest", F.col("max_id").alias("keep_id"), F.col("n").alias("group_size"))
    )
    return keyed.join(grouped, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    verdict = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(verdict, docs[id_col].cast("long").eqNullSafe(verdict["__id"]), "left_semi")


INDEX_SCHEMA = "shard int, slots binary, digests array<binary>, refs array<long>"


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX_SCHEMA)


def update_index(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The index after ``changes`` (text, op 'insert' or 'delete'): one row per shard with its filter and stored digests.

    Changes are netted per digest before they are shuffled; deleting what isn't live does nothing.  The
    number of shards has to stay the same over an index's life; a shard's filter doubles when it overflows.
    """
    net = (
        changes.select(
            F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"),
            F.when(F.col("op") == "delete", -1).otherwise(1).alias("d"),
        )
        .groupBy("digest")
        .agg(F.sum("d").alias("d"))
        .withColumn("shard", F.pmod(F.hash("digest"), F.lit(shards)))
    )

    def apply(key, old, new):
        import pandas as pd

        live = CuckooIndex(1 << 12)
        for _, row in old.iterrows():
            for digest, refs in zip(row["digests"], row["refs"], strict=True):
                live.insert(bytes(digest), references=int(refs))
        for digest, d in zip(new["digest"], new["d"], strict=True):
            digest = bytes(digest)
            if d > 0:
                live.insert(digest, references=int(d))
            elif d < 0:
                live.delete(digest, references=-int(d))
        return pd.DataFrame(
            {
                "shard": [key[0]],
                "slots": [live.table.tobytes()],
                "digests": [list(live.stored)],
                "refs": [[e[0] for e in live.stored.values()]],
            }
        )

    return index.groupBy("shard").cogroup(net.groupBy("shard")).applyInPandas(apply, INDEX_SCHEMA)


def live_digests(index: DataFrame) -> DataFrame:
    """The index as a table of its live digests and their references, to test new texts against by join."""
    return index.select(F.explode(F.arrays_zip("digests", "refs")).alias("e")).select(
        F.col("e.digests").alias("digest"), F.col("e.refs").alias("refs")
    )
