import math
import random

import numpy as np
import pytest

from treelift.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=100):
    """Every row against every anchor."""
    usable = {}
    for i, v, label in sorted(rows, key=lambda r: (str(r[0]), str(r[2]), str(r[1]))):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            usable.setdefault(i, (label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, (label, q) in usable.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), i, other) for i, (other, r) in usable.items())
        for s, p, _ in [t for t in scores if t[2] == label and t[1] != a][:5]:
            hard = [t for t in scores if t[2] != label and -80 * s <= -100 * t[0] <= -100 * s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in H.mine_hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect())


def clustered(n, size, seed):
    rnd = np.random.default_rng(seed)
    middles = rnd.standard_normal((12, size))
    x = middles[rnd.integers(0, 12, n)] + 0.3 * rnd.standard_normal((n, size))
    x[n // 2 : n // 2 + n // 4] = x[0]  # a quarter of equal vectors, of several labels
    return [(k, [float(v) for v in row / 3], int(rnd.integers(0, 4))) for k, row in enumerate(x)]


@pytest.mark.parametrize("block,pages", [(512, 4096), (16, 64)])
def test_brute_force(spark, monkeypatch, block, pages):
    monkeypatch.setattr(H, "BLOCK_ROWS", block)
    monkeypatch.setattr(H, "PAGE_ROWS", pages)
    rows = clustered(900, 6, 1)
    want = plain(rows, 30)
    assert len(want) > 300
    assert mined(spark, rows, every=30) == want


def test_edges(spark):
    rnd = random.Random(3)
    rows = [(k * 10, [rnd.uniform(-1, 1) for _ in range(rnd.randint(0, 5))], rnd.choice([0, 1, None, -3])) for k in range(80)]
    rows += [(100, None, 1), (None, [1.0], 1), (200, [None, 1.0], 0), (300, [float("nan")], 0), (301, [float("inf")], 0), (303, [9000.0, -9000.0], 0), (302, [5e5] * 3, 1), (400, [3e5, 2e5], 1)]
    rows += [(10, [0.5], 0), (10, [0.5], 0), (-100, [0.25, 0.5], 1)]
    unique = {}
    for r in rows:
        unique.setdefault(r[0], []).append(r)
    rows = [r for group in unique.values() for r in (group if len(group) == 1 else [group[0], group[0]])]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as q", "2 as anchor", "'x' as block")
    assert sorted(tuple(r) for r in H.mine_hard_negatives(table).collect()) == plain(rows)
    assert H.mine_hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bits,size", [(1, 5), (2, 3), (3, 2), (2, 4)])
def test_curve_visits_neighbours(bits, size):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * size)).reshape(size, -1).T
    order = np.lexsort(H.hilbert_keys(grid, bits).T[::-1])
    steps = np.abs(np.diff(grid[order], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_bounds_hold():
    rnd = np.random.default_rng(5)
    a, points = rnd.integers(-300, 300, (20, 9)), rnd.integers(-300, 300, (50, 9))
    low, high = points.min(axis=0)[None], points.max(axis=0)[None]
    least, most = H.bounds(a, low, high)
    scores = a @ points.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()


def test_bounds_leave_blocks_out(spark, tmp_path):
    """On clustered rows most blocks are not read."""
    rnd = np.random.default_rng(2)
    middles = H.quantised(rnd.standard_normal((64, 16)))
    q = np.repeat(middles, 8, axis=0) + rnd.integers(-20, 20, (512, 16))
    low, high = q.reshape(64, 8, 16).min(axis=1), q.reshape(64, 8, 16).max(axis=1)
    n = 64
    pack = H.Windows({"anchor": [0] * n, "positive": [1] * n, "label": [9] * n, "low_score": [None] * n, "high_score": [None] * n,
                      "floor_score": [int(m @ m) * 9 // 10 for m in middles], "floor_id": [0] * n}, middles)
    zones = {"low": low.astype(np.int32).tobytes(), "high": high.astype(np.int32).tobytes(), "least_id": [1] * 64, "least_label": [0] * 64, "most_label": [0] * 64}
    met, _ = pack.may_meet(zones)
    assert met[np.arange(64), np.arange(64)].all() and met.mean() < 0.2
