import random

import numpy as np

from mosaiq.llm import hard_negatives as X

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, every=100, positives=5, negatives=10):
    ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, y, _ in rows if i is not None and y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out, seen = [], set()
    for i, y, a in ok:
        if i % every or (i, y, tuple(a)) in seen:
            continue
        seen.add((i, y, tuple(a)))
        scored = sorted((-sum(p * q for p, q in zip(a, b, strict=True)), j, z == y) for j, z, b in ok if j != i and len(a) == len(b))
        for s, p, _ in [t for t in scored if t[2]][:positives]:
            hard = [t for t in scored if not t[2] and 30 * -s <= 100 * -t[0] <= 90 * -s][:negatives]
            out += [(i, p, k, t[1], -s, -t[0]) for k, t in enumerate(hard, 1)]
    return sorted(out)


def found(frame, **how):
    return sorted(tuple(r) for r in X.mine(frame, **how).collect())


def test_rows_equal_brute_force(spark):
    rng, rnd = np.random.default_rng(1), random.Random(1)
    centres = rng.standard_normal((6, 9))
    rows = []
    for i in range(700):
        y = rnd.choice([0, 0, 0, 1, 2, 9])
        v = (centres[y % 6] * rnd.choice([0, 0.3, 1]) + rng.standard_normal(9) * 0.5) * rnd.choice([1, 1, 1, 8])
        rows.append((i, [float(x) for x in np.float32(v)], y, "x"))
    copies = [(700 + k, rows[3][1], rows[3][2] if k % 2 else 5, "x") for k in range(200)]  # ties
    bad = [(1000, None, 1, ""), (1100, [None] * 9, 1, ""), (1200, [float("nan")] * 9, 1, ""), (1300, rows[0][1], None, ""), (None, rows[0][1], 1, ""), (1400, [], 1, ""), (1500, [1.0, 2.0], 1, ""), (1501, [1.0, 1.5], 1, ""), (1502, [1.0, -0.5], 2, ""), (1503, [float("-inf")] * 9, 2, "")]
    every = rows + copies + bad + rows[100:103]
    frame = spark.createDataFrame(every, SCHEMA).repartition(6)
    right = brute(every)
    assert len(right) > 100 and found(frame) == right
    assert found(frame, block=3) == right  # several blocks
    assert found(frame.drop("score"), every=50) == brute(every, 50)


def test_intervals_drop_pairs_early_and_lose_none():
    rng = np.random.default_rng(2)
    q, a = rng.integers(-300, 300, (400, 32)).astype(float), rng.integers(-300, 300, (20, 32)).astype(float)
    anchors = X.Anchors(np.arange(20), np.zeros(20), a)
    exact = (a @ q.T).astype(int)
    asked = []

    def possible(at, low, high):
        asked.append(low.size)
        rows = np.arange(400) if low.ndim == 2 else None
        if rows is not None:
            assert (low <= exact).all() and (exact <= high).all()
        return (high >= 300_000) & (low <= 500_000)

    at, row, score = X.surviving(anchors, np.arange(20), q, np.ones((20, 400), bool), possible)
    assert sorted(zip(at, row, score, strict=True)) == sorted((i, j, exact[i, j]) for i, j in zip(*np.nonzero((exact >= 300_000) & (exact <= 500_000)), strict=True))
    assert len(asked) > 3 and asked[-1] < asked[0] / 10  # most pairs went before the last planes


def test_edges(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(0, [1.0], 1, "")], SCHEMA)) == []
    alone = [(0, [1.0, 0.0], 1, ""), (1, [0.9, 0.1], 1, ""), (2, [0.8, 0.0], 1, "")]
    assert found(spark.createDataFrame(alone, SCHEMA)) == []
    zero = [(0, [0.0, 0.0], 1, ""), (1, [0.5, 0.1], 2, ""), (2, [0.8, 0.0], 2, "")]
    assert found(spark.createDataFrame(zero, SCHEMA)) == brute(zero) and len(brute(zero)) == 0
    zero = [(100, [0.0, 0.0], 1, ""), (1, [0.5, 0.1], 1, ""), (2, [0.8, 0.0], 2, "")]
    assert found(spark.createDataFrame(zero, SCHEMA)) == brute(zero) != []
    huge = [(100, [1e9, 1.0], 1, ""), (1, [3e9, 2.0], 1, ""), (2, [7.0, 0.0], 2, "")]
    assert isinstance(found(spark.createDataFrame(huge, SCHEMA)), list)
