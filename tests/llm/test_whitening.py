import random
from fractions import Fraction

import numpy as np

from mosaiq.llm import whitening as X

SCHEMA = "vec_id long, embedding array<float>, n string"


def vectors(seed, rows, size):
    rng = np.random.default_rng(seed)
    mix = rng.standard_normal((size, size))
    return (rng.standard_normal((rows, size)) @ mix * 0.3 + 5 * rng.standard_normal(size)).astype(np.float32)


def integers(c):
    return np.floor(1024 * c.astype(float)).astype(int) + 100000


def test_rows_equal_exact_sums_and_numpy(spark):
    c = vectors(1, 300, 12)
    table = [(i, list(map(float, v)), "x") for i, v in enumerate(c)]
    bad = [(900, None, "x"), (901, [None] + [0.0] * 11, "x"), (902, [float("nan")] * 12, "x"), (903, [float("inf")] + [0.0] * 11, "x"), (904, [], "x"), (905, [1.0, 2.0], "x")]
    got = X.whiten(spark.createDataFrame(table + bad + table[:3], SCHEMA).repartition(5)).toPandas()
    x = integers(np.concatenate([c, c[:3]]))
    n, s = len(x), x.sum(axis=0)
    assert set(got.vec_id) == set(range(300)) and len(got) == n * 8 and set(got.n) == {n}
    y = n * x - s
    values, z = np.linalg.eigh(y.T.astype(float) @ y / float(n) ** 3)
    values, z = values[::-1], z[:, ::-1]
    first = got.drop_duplicates(["vec_id", "component"])
    assert (first[first.component == 1].sort_values("vec_id").deviation.to_numpy() == [sum(int(v) ** 2 for v in row) for row in y[:300]]).all()
    whitened = first.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    right = (y[:300] / n) @ z[:, :8] / np.sqrt(values[:8])
    assert np.abs(np.abs(whitened) - np.abs(right)).max() < 1e-10
    assert np.abs(whitened * np.sign((whitened * right).sum(axis=0)) - right).max() < 1e-10
    assert np.allclose(first.groupby("component").explained.first(), values[:8] / values.sum(), rtol=1e-12)
    assert set(first.identity_error) == {got.identity_error[0]} and 0 <= got.identity_error[0] < 1e-10


def test_covariance_keeps_what_doubles_lose(spark):
    """Large means and many tasks: the pair of doubles is right to 100 bits, against fractions."""
    rng = np.random.default_rng(2)
    c = (rng.standard_normal((400, 5)) + np.array([1e5, -3e4, 7, 0, 1e6])).astype(np.float64)
    rows = spark.createDataFrame([(list(map(float, v)),) for v in c], "v array<double>").repartition(7)
    n, sums = X._sums(rows)
    x = integers(c)
    assert n == 400 and (sums == x.sum(axis=0)).all()
    high, low = X.covariance(rows, n, sums)
    y = [[Fraction(int(a) * n - int(s), n) for a, s in zip(row, sums, strict=True)] for row in x]
    for i in range(5):
        for j in range(5):
            exact = sum(r[i] * r[j] for r in y) / n
            size = sum(abs(r[i] * r[j]) for r in y) / n
            assert abs(exact - Fraction(high[i, j]) - Fraction(low[i, j])) <= size * Fraction(1, 2**95)


def test_error_free_steps():
    rnd = random.Random(3)
    a, b = (np.array([rnd.uniform(-1, 1) * 10 ** rnd.randint(-8, 8) for _ in range(200)]) for _ in range(2))
    s, e = X.two_sum(a, b)
    assert all(Fraction(p) + Fraction(q) == Fraction(u) + Fraction(v) for p, q, u, v in zip(a, b, s, e, strict=True))
    h, l = X.split(a)
    assert (h + l == a).all()
    whole = np.array([rnd.randint(-(2**60), 2**60) for _ in range(50)])
    high, low = X.centred(whole[:, None] // 2**20, 999_983, np.array([12345]))
    for w, p, q in zip(whole // 2**20, high[:, 0], low[:, 0], strict=True):
        assert abs(Fraction(int(w)) - Fraction(12345, 999_983) - Fraction(p) - Fraction(q)) <= abs(Fraction(p)) * Fraction(1, 2**100)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert X.whiten(empty).collect() == [] and X.whiten(spark.createDataFrame([(1, None, ""), (2, [], "")], SCHEMA)).collect() == []
    one = X.whiten(spark.createDataFrame([(1, [0.5, 0.25], ""), (None, [0.5, 0.25], "")], SCHEMA)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, k, 2, 0, None, 0.0, None) for i in (1, None) for k in (1, 2)]
    flat = X.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "") for i in range(9)], SCHEMA)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and all(r.identity_error < 1e-12 for r in flat)
    huge = X.whiten(spark.createDataFrame([(i, [1e30 * (-1) ** i, float(i)], "") for i in range(4)], SCHEMA)).collect()
    assert all(r.deviation is None for r in huge) and len(huge) == 8
    long = X.whiten(spark.createDataFrame([(i, list(map(float, v)), "") for i, v in enumerate(vectors(4, 30, 200))], SCHEMA)).collect()
    assert len(long) == 240
