import hashlib
import random

from treelift.llm.exact_dedup import (
    CuckooIndex,
    drop_exact_duplicates,
    empty_index,
    exact_duplicates,
    live_digests,
    update_index,
)


def digest(n):
    return hashlib.sha256(str(n).encode()).digest()


def test_filter_never_misses_and_deletes():
    index = CuckooIndex(8)
    for n in range(5000):
        assert index.insert(digest(n), n, hit=bool(index.maybe([digest(n)])[0])) is False
    assert index.maybe([digest(n) for n in range(5000)]).all()
    assert index.maybe([digest(n) for n in range(5000, 25000)]).mean() < 0.01
    assert index.mask + 1 >= 5000 // 4
    for n in range(0, 5000, 2):
        assert index.delete(digest(n))
    assert not index.delete(digest(0))
    assert index.maybe([digest(n) for n in range(1, 5000, 2)]).all()
    assert index.maybe([digest(n) for n in range(0, 5000, 2)]).mean() < 0.05
    assert index.insert(digest(1)) is True


def test_groups(make_docs):
    rnd = random.Random(1)
    texts = [rnd.choice(["Ab c", "aB C", "x", "É", "é", None, "", "y" * 100_000]) for _ in range(300)]
    found = {r.doc_id: r for r in exact_duplicates(make_docs(texts)).collect()}
    norm = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
    for k, t in enumerate(norm):
        same = [i for i, x in enumerate(norm) if x == t]
        assert (found[k].keep_id, found[k].group_size, found[k].kept) == (max(same), len(same), k == max(same))
        assert found[k].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_edges(spark, make_docs):
    assert exact_duplicates(make_docs([])).count() == 0
    repeated = make_docs([(1, "a"), (1, "a"), (None, "a"), (None, "b")])
    rows = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exact_duplicates(repeated).collect())
    assert rows == [(-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]
    extra = make_docs(["a", "A"]).selectExpr("*", "1 as digest", "2 as keep_id", "3 as n")
    kept = drop_exact_duplicates(extra)
    assert kept.columns == extra.columns
    assert [r.doc_id for r in kept.collect()] == [1]


def test_index_updates(spark):
    change = lambda rows: spark.createDataFrame(rows, "text string, op string")
    index = update_index(empty_index(spark), change([("a", "insert"), ("A", "insert"), ("b", "insert")]), 3)
    index = update_index(index, change([("b", "delete"), ("a", "delete"), ("zz", "delete"), ("c", "insert")]), 3)
    live = {bytes(r.digest): r.refs for r in live_digests(index).collect()}
    assert live == {hashlib.sha256(t).digest(): 1 for t in (b"a", b"c")}
