import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from treelift.llm.suffix_dedup import OUTSIDE, remove_repeats, repeated_starts


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(rnd, length):
    letters = "abcdefghij é"
    make = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [make(rnd.randint(length - 6, 3 * length)) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = make(rnd.randint(0, 4 * length))
        for _ in range(rnd.randint(0, 2)):
            t += rnd.choice(passages)[rnd.choice([0, 0, 3]) :] + make(rnd.randint(0, length))
        if rnd.random() < 0.3 and t:
            at = rnd.randrange(len(t))
            texts.append(t[:at] + "#" + t[at + 1 :])
        texts.append(t)
    return [*texts, texts[0], texts[1], "z" * 5 * length, "xy" * 2 * length, "x" + "yx" * 2 * length, None, "", "é" * length]


@pytest.mark.parametrize("length,gram,limit", [(20, 4, 10**6), (20, 4, 2), (64, 8, 10**6)])
def test_against_brute_force(make_docs, length, gram, limit):
    texts = corpus(random.Random(length + limit), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(make_docs(texts), length, gram, limit).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_column_rounds():
    rnd = np.random.default_rng(3)
    segments = rnd.integers(0, 2, (60, 14)).astype(np.int16)
    segments[:5, 10:] = OUTSIDE
    groups = np.sort(rnd.integers(0, 6, 60))
    found = repeated_starts(segments, groups, 5)
    for i in range(60):
        for c in range(10):
            s = segments[i, c : c + 5]
            want = OUTSIDE not in s and any(
                j != i and groups[j] == groups[i] and (segments[j, c : c + 5] == s).all() for j in range(60)
            )
            assert found[i, c] == want


def test_edges(make_docs):
    assert remove_repeats(make_docs([])).count() == 0
    long = "ab cd" * 100
    docs = make_docs([(None, long), (None, "q" * 399), (7, long), (7, long), (7, "short")]).selectExpr("*", "1 as anchor", "2 as marks")
    rows = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in remove_repeats(docs).collect())
    assert rows == [(-1, 399, 0), (-1, 500, 500), (7, 5, 0), (7, 500, 500), (7, 500, 500)]
