import gc
import math
import random
import re
import weakref
import zlib

import numpy as np

from treelift.llm import toxicity as T
from treelift.llm.toxicity import BlockMaxIndex, Neighbours, Vectors, drop_toxic, isotonic, score_documents, term_counts


def test_nearest_are_exact():
    rnd = np.random.default_rng(4)
    rows, dense = [], np.zeros((500, 20))
    for k in range(500):
        terms = np.sort(rnd.choice(20, rnd.integers(1, 6), replace=False))
        weights = rnd.random(len(terms))
        weights /= np.linalg.norm(weights)
        rows.append((terms, weights))
        dense[k, terms] = weights
    index = BlockMaxIndex(Vectors.of(rows), 20)
    for k in range(100):
        cosines = dense @ dense[k]
        want = np.lexsort((np.arange(500), -cosines.round(12)))[:16]
        ids, got = index.nearest(*rows[k], 16)
        assert np.allclose(got, cosines[want]) and np.allclose(np.sort(cosines[ids]), np.sort(cosines[want]))
    assert len(BlockMaxIndex(Vectors.of([]), 3).nearest(np.array([0]), np.array([1.0]), 5)[0]) == 0


def model(examples, vocabulary):
    """examples: (id, label, {term: count})."""
    at = {t: k for k, t in enumerate(vocabulary)}
    counted = Vectors.of([(np.array([at[t] for t in c], np.int64), np.array(list(c.values()), float)) for _, _, c in examples])
    return Neighbours(np.array([e[0] for e in examples], np.int64), np.array([e[1] for e in examples], np.int64), counted, at, np.ones(len(at)), 1.0)


def test_isotonic():
    x, y = isotonic([0.1, 0.2, 0.2, 0.5, 0.9, 0.9], [0, 1, 0, 0, 1, 1])
    assert list(x) == sorted(x) and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1
    assert len(set(x)) == len(x) and abs(np.interp(0.7, x, y) - 0.6) < 0.2  # between the steps, not on one
    assert len(isotonic([], [])[0]) == 0
    assert model([], []).vote({"a": 1}) == (0.0, [])


def test_terms():
    assert term_counts("RUNNING runner Run ÉTÉ été 12 x_1") == {"running": 1, "runner": 1, "run": 1, "été": 2, "12": 1, "x_1": 1}
    assert sum(term_counts("字" * 50).values()) == 13 and term_counts(None) == {}


def test_every_term_counts():
    """A rare term that a single example holds still decides which example is nearest; a term that no example holds is in the norm."""
    voted = model([(1, 1, {"aaaa": 1, "bbbb": 1}), (2, 0, {"aaaa": 1, "cccc": 1}), (3, 0, {"dddd": 2})], ["aaaa", "bbbb", "cccc", "dddd"])
    assert [(e[0], round(e[1], 12)) for e in voted.vote({"bbbb": 1})[1]] == [(1, round(0.5**0.5, 12))]
    assert [(e[0], round(e[1], 12)) for e in voted.vote({"bbbb": 1, "zzzz": 1})[1]] == [(1, 0.5)]
    assert [e[0] for e in voted.vote({"aaaa": 1, "cccc": 1})[1]] == [2, 1]
    assert voted.vote({"zzzz": 1}) == (0.0, [])


def plain_votes(texts, examples, df, n):
    """Share of label 1 among the votes on each text, from whole dictionaries. examples: (id, label, text)."""
    words = lambda t: {w: t.casefold().split().count(w) for w in re.findall(r"\w+", t.casefold())}
    held = {w for _, _, t in examples for w in words(t)}
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in held else 0))) + 1

    def unit(t):
        v = {w: (1 + math.log(c)) * idf(w) for w, c in words(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    kinds = [[unit(t) for _, label, t in examples if label == k] for k in (0, 1)]
    contrast = {}
    for w in held:
        has = [sum(w in v for v in kind) for kind in kinds]
        share = [(h + 0.5) / (len(kind) + 1) for h, kind in zip(has, kinds)]
        both = (sum(has) + 0.5) / (len(examples) + 1)
        contrast[w] = max(0, abs(share[1] - share[0]) / math.sqrt(both * (1 - both) * (1 / len(kinds[0]) + 1 / len(kinds[1]))) - T.NOISE) ** 2
    vectors = [(label, unit(t)) for _, label, t in examples]
    out = []
    for t in texts:
        q = unit(t)
        near = sorted(((sum(x * v.get(w, 0) for w, x in q.items()), label, v) for label, v in vectors), key=lambda r: -r[0])[: T.NEIGHBOURS]
        power = [(T.FLOOR * c + sum(x * v.get(w, 0) * contrast.get(w, 0) for w, x in q.items()), label) for c, label, v in near]
        total = sum(p for p, _ in power)
        out.append(sum(p for p, label in power if label) / total if total and any(w in held for w in q) else 0.0)
    return out


def test_scores_against_brute_force(spark, make_docs, monkeypatch):
    monkeypatch.setattr(T, "OPENED", 1)
    texts, toxic = corpus(300, 5)
    texts = [f"{t} w{k % 7} W{k % 11}" for k, t in enumerate(texts)]
    labelled = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = {}
    for t in texts:
        for w in set(re.findall(r"\w+", t.casefold())):
            df[w] = df.get(w, 0) + 1
    rows = {r.doc_id: r for r in score_documents(make_docs(texts), spark.createDataFrame([(i, toxic[i]) for i in labelled], "doc_id long, toxic int")).collect()}
    folds = {r.i: r.h for r in spark.sql(f"SELECT id AS i, pmod(xxhash64(id, 4), {T.FOLDS}) AS h FROM range(300)").collect()}
    crossed = []
    for h in range(T.FOLDS):
        mine = [i for i in labelled if folds[i] == h]
        whole = {w for i in labelled for w in re.findall(r"\w+", texts[i].casefold())}
        votes = plain_votes([texts[i] for i in mine], [(i, toxic[i], texts[i]) for i in labelled if folds[i] != h], {w: n if w in whole else 0 for w, n in df.items()}, 300)
        crossed += [(v, toxic[i]) for v, i in zip(votes, mine)]
    x, y = isotonic(*zip(*crossed))
    want = np.interp(plain_votes(texts, [(i, toxic[i], texts[i]) for i in labelled], df, 300), x, y)
    assert np.mean(np.abs([rows[i].score - want[i] for i in range(300)]) < 1e-6) > 0.97  # the two calibrations differ by the norms of unknown terms of a fold


def corpus(n, seed):
    rnd = random.Random(seed)
    bad = ["vile", "rotten", "filthy"]
    texts, toxic = [], []
    for _ in range(n):
        words = ["".join(rnd.choice("aeioulmnst") for _ in range(rnd.randint(2, 7))) for _ in range(rnd.randint(5, 60))]
        toxic.append(int(rnd.random() < 0.2))
        if toxic[-1]:
            for _ in range(3):
                words[rnd.randrange(len(words))] = rnd.choice(bad).upper()
        texts.append(" ".join(words))
    return texts, toxic


def test_held_out_accuracy(spark, make_docs):
    texts, toxic = corpus(900, 1)
    docs = make_docs(texts).selectExpr("*", "1 as toxic", "2 as score", "3 as terms")
    labels = spark.createDataFrame(list(enumerate(toxic))[:600], "doc_id long, toxic int").selectExpr("*", "0 as quality")
    rows = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    assert len(rows) == 900 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    unseen = [i for i in rows if rows[i].held_out or i >= 600]
    assert np.mean([rows[i].predicted == toxic[i] for i in unseen]) > 0.97
    assert any(rows[i].evidence for i in unseen)
    clean = {r.doc_id for r in drop_toxic(docs, labels).collect()}
    assert clean == {i for i, r in rows.items() if not r.predicted}


def test_edges(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in score_documents(make_docs(["a", None, ""]), none).collect()] == [0.0] * 3
    texts, toxic = corpus(120, 2)
    labels = spark.createDataFrame([*enumerate(toxic), (None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    docs = make_docs([*enumerate(texts), (None, texts[0]), (7, texts[7]), (500, None), (501, "x" * 100_000)])
    rows = score_documents(docs, labels).collect()
    assert len(rows) == 124 and not any(r.held_out for r in rows if r.doc_id is None)
    assert score_documents(docs.limit(0), labels).count() == 0
    assert drop_toxic(docs, labels).columns == docs.columns


def test_words_are_those_of_the_pattern():
    marks = ["a—b «c»d x_1;y2", "日本。語　文", "été 1²½", "\x1c\x85\xa0", "ß ǅ İ", "\ud800z", "", None]
    for text in [*marks, *("".join(map(chr, range(k, k + 200))) for k in range(0, 55_000, 200))]:
        words = re.findall(r"\w+", (text or "").casefold())
        assert T._words(text) == words
        assert T.distinct_terms(text) == set(T.term_counts(text))


def test_model_goes_with_its_broadcast():
    class Shared:
        value = (np.arange(4), np.array([0, 1, 0, 1]), np.array([0, 1, 2, 0]), Vectors.of([(np.array([k % 2]), np.array([1.0])) for k in range(4)]), np.ones(2), 1.0)

    shared = Shared()
    kept = weakref.ref(T._model(shared))
    assert T._model(shared) is kept()
    T._model(shared, 0)
    gc.collect()
    assert kept() is None and len(T._models[shared]) == 1
    kept = weakref.ref(T._model(shared, 0))
    del shared  # as a worker does when a later task has no use for the broadcast
    gc.collect()
    assert kept() is None and not T._models
