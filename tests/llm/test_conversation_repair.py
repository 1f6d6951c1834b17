import hashlib
import heapq
import random
import re
import zlib

import pytest

from treelift.llm.conversation_repair import cheapest, damaged, repair_conversations, repair_report, search, suffix_bounds

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(initials, faults):
    """Uniform-cost search over whole edit strings, with the output's initials as a string and the grammar as a pattern."""
    heap = [(0, "", 0, "")]
    done = set()
    while heap:
        cost, audit, row, out = heapq.heappop(heap)
        if row == len(initials) and GRAMMAR.fullmatch(out):
            return cost, audit
        if (row, out) in done or not re.fullmatch(r"(s?(ua)*u?)?", out):
            continue
        done.add((row, out))
        for role in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", row, out + role))
        if row < len(initials):
            heapq.heappush(heap, (cost + 2, audit + "D", row + 1, out))
            if faults[row] in "-t":
                stay = cost + 5 * (faults[row] == "t")
                heapq.heappush(heap, (stay, audit + "K", row + 1, out + initials[row]))
                for role in "ua":
                    heapq.heappush(heap, (stay + 1, audit + "R", row + 1, out + role))
    raise AssertionError


def plain(rows):
    """The whole result of one conversation, worked out row by row. rows: (turn, role, text) after damage, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), ""
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
        seen.add((role, text))
    cost, audit = brute([r[1][:1] for r in rows], faults)
    out, rest = [], iter(rows)
    for edit in audit:
        role, text = next(rest)[1:] if edit != "I" else ("", "")
        if edit != "D":
            if edit != "K":
                role = "assistant" if out and out[-1].startswith("u") else "user"
            out.append(f"{role}:{text}")
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (len(rows), gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)


def hurt(conv, turn, role, text):
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
    return [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


@pytest.mark.parametrize("seed", range(6))
def test_search_is_optimal(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        n = rnd.randint(0, 9)
        initials, faults = "".join(rnd.choice("uuaasx") for _ in range(n)), "".join(rnd.choice("----bdt") for _ in range(n))
        want = brute(initials, faults)
        assert cheapest(initials, faults) == want
        assert suffix_bounds(initials, faults)[0] <= want[0]


def test_segments_chain():
    rnd = random.Random(9)
    for n in (63, 64, 65, 200):
        initials, faults = "".join(rnd.choice("uuaas") for _ in range(n)), "".join(rnd.choice("-----bdt") for _ in range(n))
        whole = min(filter(None, (search(initials, faults, 0, b) for b in (0, 3))))
        assert cheapest(initials, faults) == whole == brute(initials, faults)


def make(spark, seed, convs, most):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rnd.randint(1, most)):
            role = rnd.choice(["user", "assistant", "system", None, "", "human", "Unknown"]) if rnd.random() < 0.3 else ("user", "assistant")[t % 2]
            turn = rnd.choice([t, t + 3, None, t]) if rnd.random() < 0.2 else t
            rows.append((c, turn, role, rnd.choice(["Yes.", "no", "é!\n ", "", None, " \t", "x?" * 50, "Fine. Then\n"])))
    rows += [(None, 1, "user", "hm."), (None, None, None, None), (7, 3, "user", "Yes."), (7, 3, "user", "Yes.")]
    return rows


def expected(rows):
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).extend(hurt(conv, *row))
    return {c: plain(r) for c, r in by.items()}


def test_report(spark):
    rows = make(spark, 1, 60, 9)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as pos", "'x' as audit")
    got = {r[0]: tuple(r)[1:] for r in repair_report(table).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    assert {c: (r, want[c]) for c, r in got.items() if r != want[c] and r[7] == want[c][7]} == {}
    # a role that is empty can't be kept here; the plain search lets it stand for nothing
    assert all(r == want[c] for c, r in got.items() if not any(x[0] == c and x[2] == "" for x in rows))


def test_long_conversations_go_by_segments(spark):
    rows = [r for r in make(spark, 4, 5, 300) if r[2] != ""]
    hit = damaged(spark.createDataFrame(rows, SCHEMA))
    short, long = repair_conversations(hit), repair_conversations(hit, long_rows=20)
    assert sorted(map(tuple, short.collect()), key=str) == sorted(map(tuple, long.collect()), key=str)
    want = expected(rows)
    assert {r[0]: tuple(r)[1:] for r in long.collect()} == {c: w for c, w in want.items() if w[0]}


def test_edges(spark):
    assert repair_report(spark.createDataFrame([], SCHEMA)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = repair_report(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    kept = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (1, 2, 9)))
    long = "word " * 400_000 + "."
    row = repair_report(spark.createDataFrame([(kept, 1, "user", long), (kept, 2, "assistant", "Ok."), (kept, 9, "user", "?")], SCHEMA)).first()
    assert (row.gaps, row.cost, row.audit) == (6, 2, "KKD")
    assert row.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Ok.".encode()).hexdigest()
