"""Benchmark decontamination with one Aho-Corasick automaton.

Words are maximal runs of digits, letters a-z (A-Z lower-cased) and everything outside ASCII.  Every ten
consecutive words of a benchmark item form a window; an item of fewer words is one window by itself.  All
windows go into one automaton, which reads each text once, and the words that a window covers are mapped back
to character offsets of the original text.

The automaton reads words, not letters: each word of the windows has a code of two or three symbols, and every
other word of a text one that no window holds.  A window then takes 20 to 30 nodes of about 50 bytes whatever its length, and
an automaton of ``AUTOMATON_WINDOWS`` windows about 150 MB in a worker.  A larger benchmark is dealt into
blocks within that bound; only one of them is in the driver and in the workers at a time, the texts are read once per block, and
the findings are merged.

Defined results: a null or empty text has no words and is clean; items without words match nothing; items whose
id is null count as one item, named null; repeated items count once per id; an empty table of either side gives
no findings (one clean row per document); additional columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

WINDOW = 10
AUTOMATON_WINDOWS = 100_000
BASE = 256

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: bytes.translate table: A-Z to a-z, ASCII outside words to a space, bytes of other characters unchanged.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_FOUND = (
    "row long, doc_id long, n_words long, items array<string>, "
    "runs array<struct<first:long,last:long,start:long,end:long>>"
)
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_NORMAL).split()


def item_windows(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if len(words) <= window:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


_built: dict[str, Automaton | None] = {}


class Automaton:
    """The windows of a block, over codes of their words. Digits of a code are of different ranges, so matches start at words."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]) -> None:
        words = {w: k for k, w in enumerate(sorted({w for window, _ in windows for w in window.split(b" ")}))}
        self.digits = 2 if len(words) <= BASE**2 else 3
        self.codes = {w: self._code(k) for w, k in words.items()}
        self.other = chr(BASE * self.digits) * self.digits
        self.table = [(window.count(b" ") + 1, owners) for window, owners in windows]
        self.machine = ahocorasick.Automaton()
        for k, (window, _) in enumerate(windows):
            self.machine.add_word("".join(self.codes[w] for w in window.split(b" ")), k)
        self.machine.make_automaton()

    def _code(self, k: int) -> str:
        return "".join(chr(BASE * d + k // BASE**d % BASE) for d in range(self.digits))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """First and last word of every occurrence of a window, and the items that own it."""
        codes, other = self.codes, self.other
        for end, k in self.machine.iter("".join([codes.get(w, other) for w in words])):
            length, owners = self.table[k]
            last = end // self.digits
            yield last - length + 1, last, owners


class Block:
    """A broadcast block of windows; its name lets a worker keep the automaton it has built from it."""

    def __init__(self, context, windows: list[tuple[bytes, list[str]]]) -> None:
        self.name = uuid.uuid4().hex
        self.windows = context.broadcast(windows)

    def automaton(self) -> Automaton | None:
        if self.name not in _built:
            _built.clear()
            windows = self.windows.value
            _built[self.name] = Automaton(windows) if windows else None
        return _built[self.name]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def scan_text(text: bytes, automaton: Automaton | None) -> tuple[int, list[str], list[dict]]:
    """Words of a text, the items found in it, and the runs of covered words with their original offsets."""
    words = words_of(text)
    if automaton is None or not words:
        return len(words), [], []
    items: set[str] = set()
    spans: list[tuple[int, int]] = []
    for first, last, owners in automaton.matches(words):
        items.update(owners)
        spans.append((first, last))
    if not spans:
        return len(words), [], []
    original = text.decode("utf-8")
    place = [m.span() for m in _WORD.finditer(original.translate(_LOWER))]
    runs = [
        {"first": a, "last": b, "start": place[a][0], "end": place[b][1]} for a, b in _merged(spans)
    ]
    return len(words), sorted(items), runs


_LOWER = {c: c + 32 for c in range(65, 91)}


def _scan(block: Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            found = [scan_text(t or b"", automaton) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.list_(pa.string())),
                    pa.array([f[2] for f in found], pa.list_(_RUN)),
                ],
                ["row", "doc_id", "n_words", "items", "runs"],
            )

    return run


def _windows(window: int):
    """(item, text) to (item, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(item_windows(words_of(t or b""), window))) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            rows = pa.array([k for k, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), pa.array([w for f in found for w in f], pa.binary())], ["item", "window"]
            )

    return run


def window_blocks(items: DataFrame, scratch: Scratch, window: int, limit: int) -> Iterator[list[tuple[bytes, list[str]]]]:
    """The windows with the items that own them, in blocks of about ``limit`` at most; each is read to the driver by itself."""
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    rows = named.mapInArrow(_windows(window), "item string, window binary").groupBy("window").agg(F.collect_set("item").alias("items"))
    rows = scratch.keep(rows, "windows")
    n = -(-rows.count() // limit)
    if n > 1:  # hashing deals them out unevenly
        n += 1
    for k in range(max(n, 1)):
        block = rows.where(F.pmod(F.xxhash64("window"), F.lit(max(n, 1))) == k)
        yield sorted((bytes(r.window), sorted(r["items"])) for r in block.toLocalIterator())


def find_passages(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WINDOWS) -> DataFrame:
    """Per document: words, ids of the items found, and runs of covered words with original character offsets."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"
    )
    found = None
    for windows in window_blocks(items, scratch, window, limit):
        block = Block(docs.sparkSession.sparkContext, windows)
        part = rows.mapInArrow(_scan(block), _FOUND)
        if len(windows) == 0 and found is not None:
            continue
        if found is None:
            found, held = part, block
            continue
        if held is not None:  # there are several blocks: each is done with before the next is read
            found = scratch.keep(found, "found")
            held.windows.unpersist()
            held = None
        found = found.unionByName(scratch.keep(part, "found"))
        block.windows.unpersist()
    if held is not None:
        return found.drop("row")
    return (
        found.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        )
        .drop("row")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WINDOWS) -> DataFrame:
    """One row per document: covered words, items with occurring windows, and whether any was found."""
    runs = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"

    def join_run(acc, r):
        tail = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(
            tail["first"].alias("first"),
            F.greatest(tail["last"], r["last"]).alias("last"),
            tail["start"].alias("start"),
            F.greatest(tail["end"], r["end"]).alias("end"),
        )
        touches = r["first"] <= tail["last"] + 1
        return F.when(touches, F.array_append(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.array_append(acc, r))

    joined = F.aggregate("runs", F.array().cast(runs), join_run)  # runs of several automata may overlap
    found = find_passages(docs, items, window, limit).withColumn("runs", joined)
    covered = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("spans"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_WINDOWS) -> DataFrame:
    """The documents, with all their columns, in which no window of any item occurs."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    at, schema = docs.columns.index("text"), docs.schema

    def clean_by(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = block.automaton()
            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([not scan_text(t or b"", automaton)[2] for t in texts], pa.bool_()))

        return run

    clean, last = docs, None
    for windows in window_blocks(items, scratch, window, limit):
        if last is not None:
            kept = scratch.keep(clean, "clean")
            last.windows.unpersist()
            clean = kept
        last = Block(docs.sparkSession.sparkContext, windows)
        clean = clean.mapInArrow(clean_by(last), schema)
    return clean
