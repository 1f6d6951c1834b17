import random
import re

from treelift.llm.decontamination import contamination, drop_contaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        if not v:
            continue
        n = min(10, len(v))
        for i in range(len(v) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item_id)
    return len(w), len(hit), found


def test_against_brute_force(spark, make_docs):
    rnd = random.Random(3)
    vocabulary = ["a", "b", "c", "d", "É", "x1", "日本"]
    line = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, line(rnd.randint(0, 14))) for k in range(12)] + [(12, None), (12, "b a x1 d"), (13, "---")]
    texts = []
    for _ in range(80):
        t = line(rnd.randint(0, 60))
        if rnd.random() < 0.5:
            t += " " + (rnd.choice(items)[1] or "").upper() + "!" + line(3)
        texts.append(t)
    texts += [None, "", "...", "z" * 200_000]
    docs, bench = make_docs(texts), spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 20, 10):  # one automaton, and several blocks
        found = {r.doc_id: r for r in contamination(docs, bench, limit=limit).collect()}
        assert len(found) == len(texts)
        for k, t in enumerate(texts):
            n, hit, ids = brute(t, items)
            assert (found[k].n_words, found[k].n_hit, found[k].n_items) == (n, hit, len(ids))
            for s in found[k].spans:
                assert WORD.match((t[s.start : s.end]).lower())
            assert sum(len(words(t[s.start : s.end])) for s in found[k].spans) == hit


def test_drop_and_edges(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three"), (None, "four five")], "item_id long, text string")
    docs = make_docs(["x ONE, two... three y", "one two", None, "four five six"]).selectExpr("*", "1 as item_id")
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == [1, 2]
    assert drop_contaminated(docs, bench).columns == docs.columns
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert contamination(docs.limit(0), bench).count() == 0
