"""Line deduplication by winnowing over line hashes.

Lines are compared after trimming and lower-casing A-Z; lines without words are left out of the
comparison.  A window starts at every line and takes lines until it holds ``MIN_WORDS`` words, and another one ends at
every line and reaches back as far; so a long line is a window by itself and short lines make one together.
A window's fingerprint is its line of smallest hash (the last of equals).  Equal windows have equal fingerprints, so a
fingerprint that stands at one place only rules all its windows out; the others are candidates.

Frequent lines make poor evidence: the least place of a fingerprint may stand in another, shorter context than the run looked for.  So
the lines around a fingerprint are matched whole, both ways, as far as its windows reach: the key of a candidate is the hash of all its lines,
and only the least place of each key is looked for, which pre-aggregates; a line that a third of all documents hold
costs no pairs.  A run of repeated lines is the union of the windows in it: a line of it that no window from an earlier
line of the run reaches has words enough before it for the window that ends there.

A window that occurred before in the corpus (by doc_id, then line) is deleted: the first occurrence stays.

Defined results: a null text has no lines and stays null; a text that loses all its lines becomes empty; lines without words go when
the lines around them do (at an end: the one line beside them); rows repeated whole count as one document; a null id
comes before all others; an empty table gives an empty result; additional columns pass through, but for
those named n_lines, n_removed or n_runs where :func:`dedup_lines` adds these.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.llm.text import LOWER_BYTES, free_name
from treelift.sources.scratch import Scratch

MIN_WORDS = 8
NULL_ID = -(1 << 63)

_WINDOWS = "d long, t long, key long, fingerprint long, place int, first int, last int"


def line_keys(text: bytes) -> tuple[list[int], list[int], list[int]]:
    """Hash, words and place of each line that has words."""
    hashes, words, places = [], [], []
    for k, line in enumerate(text.translate(LOWER_BYTES).split(b"\n")):
        line = line.strip()
        if line:
            hashes.append(int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little", signed=True))
            words.append(len(line.split()))
            places.append(k)
    return hashes, words, places


def windows(words: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """First and last line of each window from a line on and of each up to a line."""
    found: set[tuple[int, int]] = set()
    stop = held = 0
    for start in range(len(words)):
        while stop < len(words) and held < min_words:
            held += words[stop]
            stop += 1
        if held < min_words:
            break
        found.add((start, stop - 1))
        held -= words[start]
    start = held = 0
    for stop in range(len(words)):
        held += words[stop]
        while held - words[start] >= min_words:
            held -= words[start]
            start += 1
        if held >= min_words:
            found.add((start, stop))
    return sorted(found)


def _window_rows(min_words: int):
    """(d, t, text) to the windows of each text, with the hash of all their lines and their fingerprint's hash and line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, marks, places, first, last = [], [], [], [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                hashes, words, _ = line_keys(text or b"")
                packed = array("q", hashes).tobytes()
                for a, b in windows(words, min_words):
                    digest = hashlib.blake2b(packed[8 * a : 8 * b + 8], digest_size=8).digest()
                    keys.append(int.from_bytes(digest, "little", signed=True))
                    rows.append(row)
                    at = min(range(b, a - 1, -1), key=hashes.__getitem__)
                    marks.append(hashes[at])
                    places.append(at)
                    first.append(a)
                    last.append(b)
            rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(keys, pa.int64()),
                    pa.array(marks, pa.int64()),
                    pa.array(places, pa.int32()),
                    pa.array(first, pa.int32()),
                    pa.array(last, pa.int32()),
                ],
                ["d", "t", "key", "fingerprint", "place", "first", "last"],
            )

    return run


def repeated_runs(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """Windows of lines (numbered without empty ones) that occurred before: d, t, first, last. docs: d, t, text."""
    seen = scratch.keep(docs.where("text is not null").mapInArrow(_window_rows(min_words), _WINDOWS), "seen")
    repeated = (
        seen.groupBy("fingerprint")
        .agg(*(f(c).alias(f"{n}_{c}") for c in ("d", "t", "place") for n, f in (("min", F.min), ("max", F.max))))
        .where("min_d < max_d or min_t < max_t or min_place < max_place")
        .select("fingerprint")
    )
    candidates = scratch.keep(seen.join(repeated, "fingerprint").select("d", "t", "key", "first", "last"), "candidates")
    scratch.drop(seen)
    at = F.struct("d", "t", F.col("first").alias("i"))
    firsts = candidates.groupBy("key").agg(F.count("*").alias("n"), F.min(at).alias("f")).where("n > 1").select("key", "f")
    return candidates.join(firsts, "key").where(F.col("f") < at).select("d", "t", "first", "last").distinct()


def remaining_text(text: bytes, gone: set[int], places: list[int]) -> tuple[bytes, int, int]:
    """The text without the lines gone; number of lines with words removed, and of runs."""
    lines = text.split(b"\n")
    dead = [False] * len(lines)
    for k in gone:
        dead[places[k]] = True
    for a, b in zip([-1, *range(len(places))], [*range(len(places)), -1], strict=True):
        low, high = (places[a] if a >= 0 else -1), (places[b] if b >= 0 else len(lines))
        if (a < 0 or a in gone) and (b < 0 or b in gone) and gone:
            dead[low + 1 : high] = [True] * (high - low - 1)
    runs = sum(1 for k in gone if k - 1 not in gone)
    return b"\n".join(x for x, out in zip(lines, dead, strict=True) if not out), len(gone), runs


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, runs) last; replaces them by text and three counts: lines, lines removed, runs."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist()
        out, total, removed, n_runs = [], [], [], []
        for text, runs in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            gone = {k for r in runs or [] for k in range(r["first"], r["last"] + 1)}
            if text is None:
                kept, n, m, places = None, 0, 0, []
            else:
                places = line_keys(text)[2]
                kept, n, m = remaining_text(text, gone, places) if gone else (text, 0, 0)
            out.append(kept)
            total.append(len(places))
            removed.append(n)
            n_runs.append(m)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns[:-2],
                pa.array(out, pa.binary()).cast(pa.string()),
                pa.array(total, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(n_runs, pa.int64()),
            ],
            [f"c{k}" for k in range(batch.num_columns + 2)],
        )


COUNTS = ["n_lines", "n_removed", "n_runs"]


def _cleaned(docs: DataFrame, counts: list[str], min_words: int) -> DataFrame:
    """The documents without later repeated runs, and three columns of counts that they don't have yet."""
    scratch = Scratch(docs.sparkSession, "lines")
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    runs = repeated_runs(docs.select(ident.alias("d"), F.xxhash64("text").alias("t"), "text"), scratch, min_words)
    d, t, spans = (free_name(docs, n) for n in ("d", "t", "runs"))
    runs = scratch.keep(
        runs.groupBy(F.col("d").alias(d), F.col("t").alias(t)).agg(F.collect_list(F.struct("first", "last")).alias(spans)), "runs"
    )
    others = [f"`{c}`" for c in docs.columns if c != "text"]
    joined = docs.join(runs, (ident == F.col(d)) & (F.xxhash64("text") == F.col(t)), "left").select(*others, "text", spans)
    shape = docs.select(*others, "text").schema
    for name in counts:
        shape = shape.add(name, "long")
    return joined.mapInArrow(_clean, shape)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later repeated runs of lines, and columns n_lines, n_removed, n_runs beside theirs."""
    own = [c for c in docs.columns if c.lower() not in COUNTS]
    return _cleaned(docs.select(*(F.col(f"`{c}`") for c in own)), COUNTS, min_words)


def drop_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with their columns only, without later repeated runs of lines.

    A document that loses all its text goes; n_chars, where there is such a column, follows the text.
    """
    counts = [free_name(docs, c) for c in COUNTS]
    cleaned = _cleaned(docs, counts, min_words).where((F.col(counts[1]) == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(F.col(counts[1]) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*(F.col(f"`{c}`") for c in docs.columns))


def line_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: lines with words, lines and runs removed, digest of what is left."""
    return dedup_lines(docs.select("doc_id", "text"), min_words).select(
        "doc_id", "n_lines", "n_removed", "n_runs", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )
