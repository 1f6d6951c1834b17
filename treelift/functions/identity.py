"""Hashes and ids. All are built from columns, bit for bit as a serial writer of the same JSON or records would."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.functions.paths import is_within, relative_to


def json_text(value: Column) -> Column:
    """A JSON string. Control characters are written with small hex digits, which to_json writes large."""
    for c in ("\\", '"', *map(chr, range(32))):
        value = F.replace(value, F.lit(c), F.lit(json.dumps(c)[1:-1]))
    return F.concat(F.lit('"'), value, F.lit('"'))


def candidate_id(url: Column, revision: Column, root: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.array(url, revision, root)), 256))


def ordered_digests(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The keys and the SHA-256 of ``before``, the pieces in order with ``between`` among them, and ``after``, by group.

    rows: the two keys (strings), the columns to order by, piece, and the constants before, between and after. A digest is a serial
    thing, so a group passes one task, but as a stream: rows are sorted (on disk, where they must), never gathered.
    Rows are dealt by a hash of the keys: a repartition by the keys themselves falls away above a join by them, and that join may
    come to read its rows where they were written, a group in many tasks.
    """
    parts = ["before", "between", "after", "piece"]
    sorted_rows = rows.select(*keys, *order, *parts).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*keys, *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, after = None, None, ""
        for batch in batches:
            done = []
            for *at, before, between, last, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key:
                    if digest is not None:
                        done.append((*key, _closed(digest, after)))
                    key, digest, after = at, hashlib.sha256(before.encode()), last
                else:
                    digest.update(between.encode())
                digest.update(piece.encode())
            if done:
                yield _digest_batch(done)
        if digest is not None:
            yield _digest_batch([(*key, _closed(digest, after))])

    return sorted_rows.mapInArrow(run, ", ".join(f"`{k}` string" for k in keys) + f", {name} string")


def _closed(digest, after: str) -> str:
    digest.update(after.encode())
    return digest.hexdigest()


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], [f"c{k}" for k in range(len(columns))])


def group_ids(members: DataFrame, kind: str) -> DataFrame:
    """source_id, key, group_id: digest of the JSON list of kind, key and sorted member ids. members: source_id, key, candidate_id."""
    before = F.concat(F.lit(f'["{kind}",'), json_text(F.col("key")), F.lit(',["'))
    rows = members.select(
        "source_id", "key", "candidate_id", F.col("candidate_id").alias("piece"), before.alias("before"), F.lit('","').alias("between"), F.lit('"]]').alias("after")
    )
    found = ordered_digests(rows, ["source_id", "key"], ["candidate_id"], "digest")
    return found.select("source_id", "key", F.concat(F.lit("sha256:"), "digest").alias("group_id"))


def snapshot_hashes(inventory: DataFrame) -> DataFrame:
    """source_id, snapshot_sha256: digest of the JSON list of a source's entries in order of path."""
    row = F.to_json(
        F.struct("path", "kind", "size", "executable", "symlink_target", "sha256"), {"ignoreNullFields": "false"}
    )
    rows = inventory.select("source_id", "path", row.alias("piece"), F.lit("[").alias("before"), F.lit(",").alias("between"), F.lit("]").alias("after"))
    return ordered_digests(rows, ["source_id"], ["path"], "snapshot_sha256")


def _field(value: Column) -> Column:
    """A field of a content record: its length as eight bytes, then its bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 16, "0")), value)


def content_hashes(members: DataFrame, domain: str) -> DataFrame:
    """source_id, root, content_hash over the payload entries below each root, in order of their relative path.

    members: source_id, root, and the entries joined to it. ``domain`` separates these digests from others.
    """
    path = relative_to(F.col("path"), F.col("root"))
    payload = (
        F.when(F.col("kind") == "file", F.unhex("sha256"))
        .when(F.col("kind") == "symlink", F.encode("symlink_target", "utf-8"))
        .otherwise(F.lit(b""))
    )
    record = F.concat(
        _field(F.encode(path, "utf-8")),
        _field(F.encode("kind", "utf-8")),
        _field(F.encode(F.when(F.col("executable"), "1").otherwise("0"), "utf-8")),
        _field(payload),
    )
    rows = members.where(is_within(F.col("path"), F.col("root")) & path.isNotNull())
    listed = F.array_sort(F.collect_list(F.struct(path.alias("path"), record.alias("record"))))
    start = F.lit(domain.encode() + b"\0")
    joined = F.aggregate(listed, start, lambda acc, e: F.concat(acc, e["record"]))
    return rows.groupBy("source_id", "root").agg(F.sha2(joined, 256).alias("content_hash"))
