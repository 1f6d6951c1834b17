"""Repair of conversations by depth-first branch-and-bound.

A conversation is a row of turns whose role initials should read ``(s?(ua)+)?``.  Its cheapest repair is searched over edits of
its rows: Keep, Rerole, Delete and Insert.  The search is depth first on an explicit stack.  A prefix of edits is given up when its
cost and a lower bound of what is left exceed the incumbent, when it ties and its audit can't become the smaller one, or when a
prefix that is no worse has reached the same node (row, state).  When the stack is empty the incumbent is proved optimal.

Long conversations are cut into segments of :data:`SEGMENT` rows.  A segment is searched for each pair of a state before and a state
after it, and the results are chained: of equal cost the smaller audit stays, which is safe since no audit of equal cost that
leads to the same node is a prefix of another one (the longer one would hold more insertions and so cost more).

Conversations of up to :data:`LONG_ROWS` rows and :data:`LONG_BYTES` bytes are repaired in one pass over rows sorted by
conversation.  Longer ones are put in order by ranges, searched by segment wherever the segments lie, and the results
of up to 64 neighbours at a time are chained, round by round; only the audit, which is one field of the result, and the
serial SHA-256 of the repaired text see a whole long conversation, the latter as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelift.sources.scratch import Scratch

SEGMENT = 64
LONG_ROWS = 2048
LONG_BYTES = 8 << 20

#: States of the grammar: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a row that was reroled or inserted: its role follows from the state before it.
_TURN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ACCEPTED = (START, ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}
#: Costs that are fixed: of an edit, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 1, 2, 5, 5
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = "-bdt"

RESULT = (
    "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def suffix_bounds(initials: str, faults: str) -> list[int]:
    """For each row, what the rows from it on cost at least: each row's own least cost, and one for each of the disjoint pairs of
    sound neighbours that can't stand side by side as they are."""
    bounds, pairs, own, after = [0], 0, 0, None
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        if fault == SOUND:
            if after is not None and initial + after not in LEGAL_PAIRS:
                pairs, after = pairs + 1, None
            else:
                after = initial
        else:
            own += DELETE
            after = None if fault == TRUNCATED else after
        bounds.append(own + pairs)
    return bounds[::-1]


@lru_cache(maxsize=1 << 16)
def search(initials: str, faults: str, before: int, after: int) -> tuple[int, str] | None:
    """Least (cost, audit) of edits that lead from one state to another over these rows, or None if nothing does."""
    n, bounds = len(initials), suffix_bounds(initials, faults)
    best: tuple[int, str] | None = None
    seen: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, before, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bounds[row]
            if least > best[0] or (least == best[0] and audit > best[1][: len(audit)]):
                continue
        known = seen.get((row, state))
        if known is not None and known <= (cost, audit):
            continue
        seen[row, state] = (cost, audit)
        if row == n and state == after and (best is None or (cost, audit) < best):
            best = (cost, audit)
        stack.append((row, _TURN[state], cost + INSERT, audit + "I"))
        if row == n:
            continue
        stack.append((row + 1, state, cost + DELETE, audit + "D"))
        if faults[row] in (BLANK, DUPLICATE):
            continue
        stay = cost + (STAYS_TRUNCATED if faults[row] == TRUNCATED else 0)
        stack.append((row + 1, _TURN[state], stay + REROLE, audit + "R"))
        kept = _NEXT.get((state, initials[row]))
        if kept is not None:
            stack.append((row + 1, kept, stay, audit + "K"))
    return best


Table = dict[tuple[int, int], tuple[int, str]]


def segment_table(initials: str, faults: str, before: Iterable[int] = range(4)) -> Table:
    """Least (cost, audit) from each state before the rows to each state after them."""
    found = {(a, b): search(initials, faults, a, b) for a in before for b in range(4)}
    return {k: v for k, v in found.items() if v is not None}


def chain(first: Table, second: Table) -> Table:
    """Tables of neighbouring rows to the table of both."""
    out: Table = {}
    for (a, b), (cost, audit) in first.items():
        for c in range(4):
            more = second.get((b, c))
            if more is not None:
                whole = (cost + more[0], audit + more[1])
                if (a, c) not in out or whole < out[a, c]:
                    out[a, c] = whole
    return out


def cheapest(initials: str, faults: str) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    table: Table = {(START, START): (0, "")}
    for k in range(0, max(len(initials), 1), SEGMENT):
        rows = (initials[k : k + SEGMENT], faults[k : k + SEGMENT])
        table = chain(table, segment_table(*rows, before={b for _, b in table}))
    return min(table[START, b] for b in ACCEPTED if (START, b) in table)


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[str]:
    """``role:text`` of the repaired rows, in order."""
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = _NEXT[state, role[:1]] if edit == "K" else _TURN[state]
        if edit != "K":
            role = "user" if state == USER else "assistant"
        yield f"{role}:{text}"


class Facts(NamedTuple):
    """Counts over neighbouring rows that can be chained. first and last: initials; turns: (least, greatest, number of different ones)."""

    n: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str
    last: str
    least: int | None
    most: int | None
    turns: int

    def then(self, other: Facts) -> Facts:
        same = self.most is not None and self.most == other.least
        return Facts(
            self.n + other.n,
            self.blank + other.blank,
            self.duplicate + other.duplicate,
            self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last + other.first not in LEGAL_PAIRS),
            self.first,
            other.last,
            self.least if self.least is not None else other.least,
            other.most if other.most is not None else self.most,
            self.turns + other.turns - same,
        )

    @property
    def gaps(self) -> int:
        return 0 if self.least is None else min(self.most - self.least + 1 - self.turns, (1 << 63) - 1)


def facts(initials: list[str], faults: str, turns: list[int | None]) -> Facts:
    """Facts of rows in order of turn."""
    given = [t for t in turns if t is not None]
    illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)]
    return Facts(len(initials), *counts, illegal, initials[0], initials[-1], min(given, default=None), max(given, default=None), len(set(given)))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of conversations' rows, damaged by the CRC-32 of ``conv_id:turn``: dropped, emptied, without end marks, doubled or said by the user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"),
        (F.crc32(name) % 20).alias("how"),
    )
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))
    return rows.where("how <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


#: Of a text: its last character that is no white space, empty if there is none.
def _last_character(text: Column) -> Column:
    return F.right(F.regexp_replace(text, r"[\x20\x09-\x0D]+$", ""), F.lit(1))


def _own_fault(text: Column) -> Column:
    """Blank, truncated or sound; duplicates need the other rows."""
    last = _last_character(text)
    return F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)


def _initial(role: str) -> str:
    """An initial that the grammar can know; an empty role has none."""
    return role[:1] or "?"


def _digest(parts: Iterator[str]) -> str:
    out, first = hashlib.sha256(), True
    for part in parts:
        out.update(part.encode() if first else b"\n" + part.encode())
        first = False
    return out.hexdigest()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Rows of each conversation, from rows that are sorted by it."""
    conv, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row[1:])
    if rows:
        yield conv, rows


def _with_duplicates(rows: list[tuple]) -> str:
    """Faults of a conversation's rows (turn, role, text, own fault)."""
    seen, out = set(), []
    for _, role, text, own in rows:
        said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        out.append(DUPLICATE if own != BLANK and said in seen else own)
        seen.add(said)
    return "".join(out)


_RESULT_SCHEMA = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in RESULT.split(", ")])


def _result(conv: int | None, f: Facts, cost: int, audit: str, digest: str | None) -> tuple:
    return (conv, f.n, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal, cost, audit, digest)


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def drain() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(_RESULT_SCHEMA)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RESULT_SCHEMA, strict=True)], schema=_RESULT_SCHEMA)

    for conv, rows in _runs(batches):
        faults, initials = _with_duplicates(rows), [_initial(r[1]) for r in rows]
        cost, audit = cheapest("".join(initials), faults)
        digest = _digest(repaired(audit, ((r[1], r[2]) for r in rows)))
        out.append(_result(conv, facts(initials, faults, [r[0] for r in rows]), cost, audit, digest))
        if len(out) >= 4096:
            yield drain()
    yield drain()


# Long conversations: segments, wherever they lie, and chains of segments.

_ENTRY = pa.struct([("before", pa.int8()), ("after", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_FACTS = [(n, pa.string() if n in ("first", "last") else pa.int64()) for n in Facts._fields]
_SEGMENT_SCHEMA = pa.schema([("conv", pa.int64()), ("at", pa.int64()), *_FACTS, ("table", pa.list_(_ENTRY))])
SEGMENT_ROWS = (
    "conv long, at long, " + ", ".join(f"{n} {'string' if n in ('first', 'last') else 'long'}" for n in Facts._fields)
    + ", table array<struct<before:tinyint,after:tinyint,cost:long,audit:string>>"
)


def _segment_row(conv: int | None, at: int, f: Facts, table: Table) -> pa.Table:
    entries = [{"before": a, "after": b, "cost": c, "audit": s} for (a, b), (c, s) in table.items()]
    return pa.table({k: [v] for k, v in [("conv", conv), ("at", at), *f._asdict().items(), ("table", entries)]}, schema=_SEGMENT_SCHEMA)


def _search_segment(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("pos").to_pydict()
    initials, faults = [_initial(x) for x in rows["initial"]], "".join(rows["fault"])
    return _segment_row(rows["conv"][0], rows["seg"][0], facts(initials, faults, rows["turn"]), segment_table("".join(initials), faults))


def _chain_rows(rows: pa.Table) -> pa.Table:
    rows = sorted(rows.to_pylist(), key=lambda r: r["at"])
    tables = [{(e["before"], e["after"]): (e["cost"], e["audit"]) for e in r["table"]} for r in rows]
    every = [Facts(*(r[n] for n in Facts._fields)) for r in rows]
    whole, f = tables[0], every[0]
    for table, more in zip(tables[1:], every[1:], strict=True):
        whole, f = chain(whole, table), f.then(more)
    return _segment_row(rows[0]["conv"], rows[0]["up"], f, whole)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit, dealt to its segments: each takes the edits of its rows, with the insertions before them; the last takes all that is left."""
    for batch in batches:
        for conv, audit, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out, at = [], 0
            for k, s in enumerate(segments):
                start, left = at, s["n"]
                while left or k == len(segments) - 1 and at < len(audit):
                    left -= audit[at] != "I"
                    at += 1
                out.append((conv, s["seg"], audit[start:at]))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv", "seg", "audit"])


def _render(rows: pa.Table) -> pa.Table:
    """Repaired rows of a segment; a role is null where it follows from the rows before."""
    rows = rows.sort_by("pos").to_pydict()
    source, parts = iter(zip(rows["role"], rows["text"], strict=True)), []
    for edit in rows["audit"][0]:
        role, text = next(source) if edit != "I" else (None, "")
        if edit != "D":
            parts.append((role if edit == "K" else None, text))
    return pa.table({"conv": rows["conv"][:1], "seg": rows["seg"][:1], "parts": [[{"role": r, "text": t} for r, t in parts]]}, schema=_RENDERED)


_RENDERED = pa.schema([("conv", pa.int64()), ("seg", pa.int64()), ("parts", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def _stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's repaired rows, which come sorted by conversation and segment."""
    out, conv, state, digest = [], None, None, None
    for batch in batches:
        for c, _, parts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    out.append((conv, digest.hexdigest()))
                conv, state, digest = c, START, hashlib.sha256()
            for part in parts:
                role, first = part["role"], state == START
                state = _NEXT[state, role[:1]] if role is not None else _TURN[state]
                role = role if role is not None else "user" if state == USER else "assistant"
                digest.update(f"{'' if first else chr(10)}{role}:{part['text']}".encode())
    if digest is not None:
        out.append((conv, digest.hexdigest()))
    columns = list(zip(*out, strict=True)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["conv", "digest"])


def _repair_long(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Results of long conversations' rows (conv, turn, role, text)."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    ordered = ordered.withColumn("pos", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("pos", SEGMENT.bit_length() - 1))
    ordered = scratch.keep(ordered.withColumn("said", F.sha2("text", 256)), "ordered")
    first = ordered.groupBy("conv", "role", "said").agg(F.min("pos").alias("first")).withColumnsRenamed({"conv": "c", "role": "r", "said": "s"})
    narrow = ordered.select("conv", "turn", "role", "said", "pos", "seg", _own_fault(F.col("text")).alias("own"))
    joined = narrow.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("said") == F.col("s")))
    fault = F.when((F.col("own") != BLANK) & (F.col("pos") > F.col("first")), DUPLICATE).otherwise(F.col("own"))
    coded = joined.select("conv", "seg", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), fault.alias("fault"))
    segments = scratch.keep(coded.groupBy("conv", "seg").applyInArrow(_search_segment, SEGMENT_ROWS), "segments")
    chained = segments
    for _ in range((64 - SEGMENT.bit_length()) // 6 + 1):
        chained = chained.withColumn("up", F.shiftright("at", 6)).groupBy("conv", "up").applyInArrow(_chain_rows, SEGMENT_ROWS)
    accepted = F.filter("table", lambda e: (e["before"] == START) & e["after"].isin(*ACCEPTED))
    best = F.array_min(F.transform(accepted, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"))))
    solved = scratch.keep(chained.withColumn("best", best), "solved")
    parts = segments.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("seg"), "n"))).alias("segments"))
    same = F.col("conv").eqNullSafe(F.col("c"))
    audits = solved.select(F.col("conv").alias("c"), "best.audit").join(parts, same).select("conv", "audit", "segments")
    pieces = audits.mapInArrow(_pieces, "conv long, seg long, audit string").withColumnsRenamed({"conv": "c", "seg": "s"})
    told = ordered.select("conv", "seg", "pos", "role", "text").join(pieces, same & (F.col("seg") == F.col("s"))).drop("c", "s")
    rendered = told.groupBy("conv", "seg").applyInArrow(_render, "conv long, seg long, parts array<struct<role:string,text:string>>")
    digests = rendered.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_stream_digests, "conv long, digest string").withColumnRenamed("conv", "c")
    gaps = F.when(F.col("least").isNull(), 0).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns"))
    return solved.join(digests, same).select(
        F.col("conv").alias("conv_id"), F.col("n").alias("n_rows"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", F.col("digest").alias("repaired_sha256")
    )


def repair_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """A result per conversation of rows (conv, turn, role, text): facts, cost and audit of its cheapest repair, digest of the repaired text.

    Rows go by turn, nulls first; of one turn by role and text.  A null conv is a conversation of its own.  A row's first fault counts:
    blank, duplicate, truncated.  A role without characters can't be kept.  gaps is held to the largest long.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    size = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = scratch.keep(size.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select(F.col("conv").alias("c")), "long")
    some = not long.isEmpty()
    same = F.col("conv").eqNullSafe(F.col("c"))
    short = rows.join(long, same, "left_anti") if some else rows
    coded = short.withColumn("own", _own_fault(F.col("text")))
    ordered = coded.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    done = ordered.mapInArrow(_repair_whole, RESULT)
    return done.unionByName(_repair_long(rows.join(long, same, "left_semi"), scratch)) if some else done


def repair_report(conversations: DataFrame) -> DataFrame:
    """Results of all conversations after damage; one that lost all its rows has zeros, an empty audit and the digest of nothing."""
    done = repair_conversations(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(done, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), empty)
