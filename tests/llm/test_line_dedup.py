import hashlib
import random

from treelift.llm.line_dedup import dedup_lines, drop_repeated_lines, line_keys, line_report


def fingerprints(hashes: list[int], words: list[int], min_words: int) -> list[int]:
    """Lines that have the smallest hash (the last of equals) in some window of at least ``min_words`` words."""
    found: set[int] = set()
    stop = held = 0
    queue: list[int] = []  # candidates of the window, hashes rising
    head = 0
    for start in range(len(hashes)):
        while stop < len(hashes) and held < min_words:
            while len(queue) > head and hashes[queue[-1]] >= hashes[stop]:
                queue.pop()
            queue.append(stop)
            held += words[stop]
            stop += 1
        if held < min_words:
            break
        while queue[head] < start:
            head += 1
        found.add(queue[head])
        held -= words[start]
        if head < len(queue) and queue[head] == start:
            head += 1
    return sorted(found)


def extend(own: list[int], other: list[int], at: int, other_at: int) -> tuple[int, int]:
    """First and last line of the run around a matched line in which both sides agree."""
    first = 0
    while at - first - 1 >= 0 and other_at - first - 1 >= 0 and own[at - first - 1] == other[other_at - first - 1]:
        first += 1
    last = 0
    while at + last + 1 < len(own) and other_at + last + 1 < len(other) and own[at + last + 1] == other[other_at + last + 1]:
        last += 1
    return at - first, at + last


def brute(texts, min_words):
    """Every fingerprint against the first occurrence of its line alone, with the next, and with the one before."""
    keys = [line_keys((t or "").encode()) for t in texts]
    first = {}
    at = lambda h, k: h[k] if 0 <= k < len(h) else None
    for d, (h, w, _) in enumerate(keys):
        for i in fingerprints(h, w, min_words):
            for key in (("one", h[i]), ("next", h[i], at(h, i + 1)), ("last", at(h, i - 1), h[i])):
                if None not in key:
                    first.setdefault(key, (d, i))
    out = []
    for d, (h, w, _) in enumerate(keys):
        gone = set()
        for i in fingerprints(h, w, min_words):
            for key in (("one", h[i]), ("next", h[i], at(h, i + 1)), ("last", at(h, i - 1), h[i])):
                if None in key or first[key] >= (d, i):
                    continue
                fd, fi = first[key]
                a, b = extend(h, keys[fd][0], i, fi)
                if sum(w[a : b + 1]) >= min_words:
                    gone.update(range(a, b + 1))
        out.append(gone)
    return out


def test_fingerprints_cover_every_window():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(0, 12)
        h, w = [rnd.randint(0, 5) for _ in range(n)], [rnd.randint(1, 9) for _ in range(n)]
        want = set()
        for i in range(n):
            j, held = i, 0
            while j < n and held < 8:
                held += w[j]
                j += 1
            if held >= 8:
                want.add(min(range(i, j), key=lambda k: (h[k], -k)))
        assert fingerprints(h, w, 8) == sorted(want)


def test_against_brute_force(make_docs):
    rnd = random.Random(2)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 4, 9, 20]))) for _ in range(40)]
    texts = []
    for _ in range(120):
        body = [rnd.choice(pool) for _ in range(rnd.randint(0, 8))] + [f"own {rnd.random()}" for _ in range(rnd.randint(0, 3))]
        if texts and rnd.random() < 0.4:
            source = rnd.choice(texts).split("\n")
            a = rnd.randint(0, len(source))
            body[1:1] = source[a : a + rnd.randint(1, 6)]
        texts.append("\n".join(x.upper() if rnd.random() < 0.2 else f" {x}" if rnd.random() < 0.2 else x for x in body))
    want = brute(texts, 8)
    got = {r.doc_id: r for r in dedup_lines(make_docs(texts)).collect()}
    for k, t in enumerate(texts):
        lines = t.split("\n")
        places = line_keys(t.encode())[2]
        kept = [lines[p] for i, p in enumerate(places) if i not in want[k]]
        assert got[k].n_removed == len(want[k]), k
        assert [x for x in got[k].text.split("\n") if x.strip()] == kept


def test_passage_and_edges(spark, make_docs):
    passage = "\n".join(f"line {k} of a passage that many documents share" for k in range(7))
    texts = ["intro\n" + passage, passage + "\n\nend", None, "", "\n\n", "x " * 60_000, passage, "short\nline"]
    docs = make_docs(texts).selectExpr("*", "1 as d", "2 as t", "3 as first", "4 as runs")
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert out[0].text == texts[0] and out[1].text == "\nend" and out[6].text == ""
    assert out[2].text is None and out[3].text == "" and out[4].text == "\n\n" and out[7].text == "short\nline"
    assert (out[1].n_lines, out[1].n_removed, out[1].n_runs) == (8, 7, 1)
    assert set(docs.columns) < set(dedup_lines(docs).columns)
    assert dedup_lines(docs.limit(0)).count() == 0
    rows = line_report(make_docs([(None, passage), (None, passage), (1, passage)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (-1, 0), (1, 7)]
    assert {r.kept_sha256 for r in rows if r.doc_id} == {hashlib.sha256(b"").hexdigest()}


def every_earlier_run(texts, min_words):
    """Lines that lie in a run of enough words that occurred earlier anywhere: all pairs of starts are tried."""
    keys = [line_keys((t or "").encode()) for t in texts]
    places = {}
    out = []
    for d, (h, w, _) in enumerate(keys):
        gone = set()
        for i in range(len(h)):
            for fd, fi in places.get(h[i], ()):
                other, n = keys[fd][0], 0
                while i + n < len(h) and fi + n < len(other) and h[i + n] == other[fi + n]:
                    n += 1
                if sum(w[i : i + n]) >= min_words:
                    gone.update(range(i, i + n))
            places.setdefault(h[i], []).append((d, i))
        out.append(gone)
    return out


def test_runs_of_frequent_short_lines(make_docs):
    rnd = random.Random(6)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 2, 3, 5]))) for _ in range(20)]
    passage = [rnd.choice(pool) for _ in range(20)]
    bodies = [[rnd.choice(pool) for _ in range(rnd.randint(0, 12))] for _ in range(160)]
    for body in bodies[120:140]:
        k = rnd.randint(0, len(body))
        body[k:k] = passage
    texts = ["\n".join(body) for body in bodies]
    want = every_earlier_run(texts, 8)
    got = {r.doc_id: r.n_removed for r in dedup_lines(make_docs(texts)).collect()}
    assert sum(got.values()) == sum(map(len, want))
    assert [got[k] for k in range(len(texts))] == [len(x) for x in want]


def test_order_of_frequent_lines(make_docs):
    """Whichever line of a run has the smallest hash, a run whose parts stand in other contexts before is found."""
    for k in range(6):
        a, b, c = (f"line {k} {x} of three" for x in "abc")
        got = {r.doc_id: r.n_removed for r in line_report(make_docs([f"{a}\n{b}", f"{b}\n{c}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}"])).collect()}
        assert got[3] == 3


def test_clashing_names(make_docs):
    docs = make_docs(["one two three four five six seven eight"] * 2 + ["left"])
    for clash in (["1 as n_lines", "'x' as N_Removed", "3 as n_runs"], ["5 as __d", "6 as _t", "7 as _runs"]):
        given = docs.selectExpr("*", *clash)
        out = dedup_lines(given)
        assert sorted((r["doc_id"], r["n_removed"]) for r in out.collect()) == [(0, 0), (1, 1), (2, 0)]
        left = drop_repeated_lines(given)
        assert left.columns == given.columns and {r["doc_id"] for r in left.collect()} == {0, 2}
    assert drop_repeated_lines(docs.drop("n_chars")).count() == 2
