import numpy as np
import pytest

from treelift.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, cosine=0.95):
    """All pairs, and components by repeated search."""
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    link = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if usable[a] and usable[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float32).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    link[a].add(b)
                    link[b].add(a)
    out = []
    for k in link:
        seen, todo = {k}, [k]
        while todo:
            for o in link[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        ids = [rows[s][0] for s in seen if rows[s][0] is not None]
        name = min(ids, default=None)
        out.append((rows[k][0], len(link[k]), name, rows[k][0] is not None and rows[k][0] == name))
    return sorted(out, key=str)


def planted(seed, n, size, groups, noise):
    rnd = np.random.default_rng(seed)
    rows = list(rnd.standard_normal((n, size)))
    for g in range(groups):
        rows += [rows[g] + rnd.standard_normal(size) * noise * rnd.random() for _ in range(1 + 7 * (g % 5))]
    return [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]


def got(spark, rows, **more):
    return sorted((tuple(r) for r in E.link_embeddings(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), **more).collect()), key=str)


@pytest.mark.parametrize("tile,block", [(512, 2048), (40, 2048), (100, 30)])
def test_all_pairs(spark, monkeypatch, tile, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rows = planted(3, 500, 24, 40, 0.45)
    want = plain(rows)
    assert sum(w[1] for w in want) > 400
    assert got(spark, rows, tile=tile) == want


def test_edges(spark):
    odd = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [0.95, 0.3], [3e38, 1e30], [1e-40, 0.0]]
    rows = [(k, v) for k, v in enumerate(odd)] + [(6, [1.0, 0.0]), (None, [1.0, 0.01]), (None, None), (None, [5.0, 5.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).selectExpr("*", "1 as node", "2 as turn", "'x' as vector")
    scaled = [(i, v if v is None or not any(isinstance(x, float) and 0 < abs(x) < 1e-30 or x is not None and np.isfinite(x) and abs(x) > 1e30 for x in v) else [1.0, 0.0]) for i, v in rows]
    assert sorted((tuple(r) for r in E.link_embeddings(table).collect()), key=str) == plain(scaled)
    assert E.link_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration():
    rnd = np.random.default_rng(1)
    size, pairs = 48, 20_000
    x = E.unit(rnd.standard_normal((pairs, size)))
    across = rnd.standard_normal((pairs, size))
    across = E.unit(across - (across * x).sum(1, keepdims=True) * x)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * across
    half = E.REACH * np.sqrt(0.1)
    count = (np.abs((x - y) @ E.directions(2, E.WINDOWS, size)) <= half).sum(axis=1)
    assert (count < E.least_count()).mean() < 1e-3
    random = (np.abs((x - x[::-1]) @ E.directions(2, E.WINDOWS, size)) <= half).sum(axis=1)
    assert (random >= E.least_count()).mean() < 0.01
    cuts, rounds = E.cuts_and_rounds(50_000)
    sides = [(v @ E.directions(1, cuts * rounds, size) > 0).reshape(pairs, rounds, cuts) for v in (x, y)]
    assert ((sides[0] == sides[1]).all(axis=2).any(axis=1)).mean() > 0.999


def test_windows_are_centred_on_the_query():
    rnd = np.random.default_rng(2)
    rows, queries = rnd.standard_normal((300, 7)), rnd.standard_normal((20, 7))
    want = (np.abs(rows[None] - queries[:, None]) <= 0.3).sum(axis=2)
    assert (E.collisions(rows, queries, 0.3) == want).all()
