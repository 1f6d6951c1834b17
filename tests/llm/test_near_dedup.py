import random
import re

import numpy as np
import pytest

from treelift.llm.components import components
from treelift.llm.near_dedup import LEAF_SIZE, _branch, _children, _compared_groups, _leaves, _Links, drop_near_duplicates, minwise, near_duplicates, shingle_sets, token_threshold, trees_for
from treelift.sources.scratch import Scratch


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def corpus(rnd):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([3, 12, 60, 300]))]
        for _ in range(rnd.choice([1, 3, 12])):
            changed = [word() if rnd.random() < rnd.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            texts.append(rnd.choice([" ", "\n", "\t "]).join(changed))
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} " + " ".join(word() for _ in range(60)) for _ in range(40)]
    texts += [None, "", " \n", "one", "ONE", "one two", "x" * 50_000, "É é", "é é"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize("leaf_size", [64, 2])
def test_against_brute_force(make_docs, leaf_size):
    texts = corpus(random.Random(leaf_size))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts), 4, 80, leaf_size).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 80)


def test_parameters():
    assert trees_for(0.8) <= 8 and trees_for(0.9) <= trees_for(0.8)
    assert 30 <= token_threshold(0.8) < 0.8 * 64
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 63, 4000, np.uint64))
    b = np.concatenate([a[:3000], np.unique(rnd.integers(0, 1 << 63, 500, np.uint64))])
    same = (minwise([a]) == minwise([np.unique(b)])).mean()
    assert abs(same - 3000 / (len(a) + 500)) < 0.2
    assert [len(s) for s in shingle_sets([b"a b c d e", b"", b"x y", b"q q q q q q"], 4)] == [2, 0, 1, 1]
    nodes = np.arange(5, dtype=np.uint64)
    assert (_children(nodes, minwise([a] * 5), np.zeros((5, 1), np.int64)) == _children(nodes, minwise([a] * 5), np.zeros((5, 1), np.int64))).all()
    assert list(_branch(iter([]))) == []


def test_edges(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    docs = make_docs([(5, "a b c d e f"), (5, "a b c d e f"), (None, "A b c d e f"), (None, None), (2, "")])
    docs = docs.selectExpr("*", "1 as rep", "2 as tokens", "3 as component_id")
    rows = [(r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(docs).collect()]
    assert sorted(rows) == [(-1, -1, True), (-1, 5, False), (2, 2, True), (5, 5, True), (5, 5, True)]
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (2, ""), (5, "a b c d e f")]


def test_large_group_of_middling_copies(make_docs):
    """One group of near copies, edited more or less, some beyond any link: contraction and the stream past a core."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(9999)}" for _ in range(120)]
    texts = []
    for _ in range(700):
        share = rnd.choice([0.005, 0.01, 0.03, 0.06, 0.09])
        texts.append(" ".join(f"x{rnd.randrange(9999)}" if rnd.random() < share else w for w in base))
    texts += [" ".join(base[:40] + [f"y{rnd.randrange(9999)}" for _ in range(80)]) for _ in range(100)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts), 4, 80).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 4, 80)


def test_rows_of_a_large_group_stay_in_proportion(spark):
    """20,000 near copies of one text: rows to compare are a small multiple of the members, not of their square."""
    rnd = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(20_000):
        words = list(base)
        words[rnd.randrange(150)] = f"x{k}"
        texts.append((k, " ".join(words)))
    sets = shingle_sets([t.encode() for _, t in texts], 5)
    tokens = minwise(sets)
    reps = spark.createDataFrame([(k, t.tobytes()) for k, t in enumerate(tokens)], "rep long, tokens binary")
    scratch = Scratch(spark, "t")
    links = _Links(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80, scratch)
    groups = _compared_groups(_leaves(scratch.keep(reps, "reps"), trees_for(0.8), links, 64)).count()
    assert groups <= 2 * len(texts)
    assert links.labels.groupBy("component").count().count() == 1


def test_a_group_meets_its_others_once(spark):
    """Near copies of very different closeness, many beyond any link: nodes that hold much the same documents are compared as one."""
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(3000):
        share = rnd.choice([0.005, 0.02, 0.05, 0.08])
        texts.append((k, " ".join(f"x{rnd.randrange(10**6)}" if rnd.random() < share else w for w in base)))
    tokens = minwise(shingle_sets([t.encode() for _, t in texts], 4))
    scratch = Scratch(spark, "t")
    reps = scratch.keep(spark.createDataFrame([(k, t.tobytes()) for k, t in enumerate(tokens)], "rep long, tokens binary"), "reps")
    links = _Links(spark.createDataFrame(texts, "doc_id long, text string"), 4, 80, scratch)
    n = _compared_groups(_leaves(reps, trees_for(0.8), links, LEAF_SIZE)).count()
    assert n <= 6 * len(texts), n


def test_components(spark):
    rnd = random.Random(9)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, rnd.randint(101, 300)) for _ in range(200)] + [(400, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(61)) and {got[k] for k in got if 100 <= k <= 300} == {100} and 400 not in got
