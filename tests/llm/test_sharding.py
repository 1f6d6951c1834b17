import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from treelift.llm.sharding import minimax_cuts, shard_documents


def greedy(sizes, capacity, shards):
    out, used, at = [], 0, 0
    for s in sizes:
        if s > capacity:
            return None
        if used + s > capacity:
            at, used = at + 1, 0
        out.append(at)
        used += s
    return out if at < shards else None


def brute(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid, shards) is not None else (mid + 1, high)
    return low, greedy(sizes, low, shards)


@pytest.mark.parametrize("n,shards", [(3, 24), (40, 5), (3000, 24), (1, 2), (0, 4)])
def test_cuts(spark, n, shards):
    rnd = random.Random(n)
    groups = sorted((hashlib.sha256(str(k).encode()).hexdigest().upper(), rnd.choice([8, 20, 500, 40_000])) for k in range(n))
    capacity, cuts = minimax_cuts(spark.createDataFrame(groups, "key string, bytes long"), shards)
    want, shard = brute([s for _, s in groups], shards)
    assert capacity == want
    assert [sum(k > c.ljust(64, "F") for c in cuts) for k, _ in groups] == shard


def test_documents(make_docs):
    rnd = random.Random(5)
    texts = [rnd.choice(["hot", None, "", "é" * rnd.randint(1, 90)]) for _ in range(2000)]
    rows = shard_documents(make_docs(texts), 24).collect()
    assert len(rows) == 2000
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 8, zlib.crc32(t), "bytes", None)
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())


def test_edges(make_docs):
    assert shard_documents(make_docs([])).count() == 0
    rows = shard_documents(make_docs([(None, "a"), (1, "a"), (1, "a")]).selectExpr("*", "1 as digest", "2 as salt"), 3)
    assert sorted(r.slot for r in rows.collect()) == [0, 1, 2]
