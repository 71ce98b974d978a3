from dataclasses import replace

import numpy as np
import pytest

from mosaiq import queries
from mosaiq.functions import spectral as S
from mosaiq.matrix import TiledMatrix
from mosaiq.operators import divide as D
from mosaiq.operators import eigen, shape


def matrices(n, rng):
    yield np.full(n, 2.0), np.full(n - 1, -1.0)
    yield rng.standard_normal(n), rng.standard_normal(n - 1)
    yield np.floor(rng.standard_normal(n) * 3), np.floor(rng.standard_normal(n - 1) * 2)  # equal poles, cuts of zero
    yield np.ones(n), np.zeros(n - 1)  # all is deflated
    yield np.abs(np.arange(n) - n // 2) * 1.0, np.ones(n - 1)  # pairs of close eigenvalues
    yield 10.0 ** rng.uniform(-9, 3, n), 10.0 ** rng.uniform(-9, 1, n - 1)


# Orders and tiles.
@pytest.mark.parametrize("n,nb", [(4, 2), (16, 16), (16, 8), (16, 5), (93, 7)])
def test_eigenpairs_in_tiles(spark, n, nb):
    kinds = list(matrices(n, np.random.default_rng(n)))
    for d, e in kinds if nb == 5 else kinds[1:3]:
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        values, q = D.divide_and_conquer(spark, d, e, nb, nb if n < 93 else 14)
        z, size = q.to_numpy(), max(1, abs(t).max())
        assert abs(t @ z - z * values).max() < 1e-13 * size and abs(z.T @ z - np.eye(n)).max() < 1e-13
        assert np.allclose(values, np.linalg.eigvalsh(t), atol=1e-13 * size) and (np.diff(values) >= 0).all()


def test_no_task_holds_the_whole(spark, monkeypatch):
    """Strips and inner eigenvectors stay below the order squared; roots come in several ranges."""
    n, nb, seen = 96, 8, []
    d, e = next(m for k, m in enumerate(matrices(n, np.random.default_rng(1))) if k == 1)
    ranges, solve = [], D.solve_secular
    monkeypatch.setattr(D, "HELD", 400)
    monkeypatch.setattr(D, "solve_secular", lambda s, m: (ranges.append([len(x.poles) for x in m]), solve(s, m, 400))[1])
    stored = D.Scratch.stored

    def watched(self, frame):
        seen.append(frame._jdf.queryExecution().toString())
        return stored(self, frame)

    monkeypatch.setattr(D.Scratch, "stored", watched)
    values, q = D.divide_and_conquer(spark, d, e, nb, nb)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    z = q.to_numpy()
    assert abs(t @ z - z * values).max() < 1e-12
    assert [len(r) for r in ranges] == [len(level) for level in D.levels(12)] and sum(map(len, ranges)) == 11
    # The last merge needs more ranges than one, and each level is one shuffle by tile rows.
    assert ranges[-1][0] ** 2 > 5 * 400 and all("hashpartitioning(ti" in p and "Join" not in p for p in seen[1:])


@pytest.mark.parametrize("k", [1, 2, 7, 60])
def test_secular_roots_interlace_and_fit(k):
    rng = np.random.default_rng(k)
    for gaps in (rng.uniform(0.1, 1, k), 10.0 ** rng.uniform(-11, 0, k)):
        d, z, rho = np.cumsum(gaps), 10.0 ** rng.uniform(-4, 0, k), 10.0 ** rng.uniform(-2, 2)
        pole, x = (np.concatenate(v) for v in zip(*(S.secular_range(d, z, rho, lo, min(lo + 7, k)) for lo in range(0, k, 7)), strict=True))
        root = d[pole] + x
        assert (root >= d).all() and (root[:-1] <= d[1:]).all() and root[-1] <= d[-1] + rho * (z @ z) * (1 + 1e-15)
        assert np.allclose(np.sort(np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z))), root, atol=1e-12 * root[-1])
        logs = sum(S.weight_logs(d, rho, lo, pole[lo : lo + 7], x[lo : lo + 7]) for lo in range(0, k, 7))
        assert np.allclose(np.exp(logs / 2), z, rtol=1e-6)


def test_column_types():
    live = np.array([True, True, False, True, True, True])
    none = np.zeros((0, 4))
    assert D.column_types(3, 6, none, live).tolist() == [D.UPPER, D.UPPER, D.DEFLATED, D.LOWER, D.LOWER, D.LOWER]
    turned = np.array([[1, 3, 0.6, 0.8], [3, 4, 0.6, 0.8]])
    assert D.column_types(3, 6, turned, np.array([True, False, True, False, True, True])).tolist() == [D.UPPER, D.DEFLATED, D.UPPER, D.DEFLATED, D.DENSE, D.LOWER]


@pytest.mark.parametrize("split,kind", [(8, "d"), (10, "d"), (0, "d"), (20, "z")])
def test_typed_product_equals_the_dense_one_with_less_work(spark, split, kind):
    rng = np.random.default_rng(4)
    types = rng.integers(0, 3, 13)
    q = rng.standard_normal((20, 13)) + (1j if kind == "z" else 0) * rng.standard_normal((20, 13))
    rows = np.arange(20)[:, None]
    q = np.where((types == D.UPPER) & (rows >= split) | (types == D.LOWER) & (rows < split), 0, q)
    u = lambda i, j: np.cos(3.0 * i + j)
    work = spark.sparkContext.accumulator(0)
    got = D.typed_product(TiledMatrix.from_numpy(spark, q, 4, 4), split, types, u, 9, work).to_numpy()
    assert np.allclose(got, q @ u(np.arange(13)[:, None], np.arange(9)[None, :]))
    assert work.value < 20 * 13 * 9


def test_heevd_in_tiles_of_a_complex_matrix(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((22, 22)) + 1j * rng.standard_normal((22, 22))
    a = a + a.conj().T
    e = eigen.heevd("U", TiledMatrix.from_numpy(spark, a, 6, 6), strategy="tiles", band=3, end=9)
    z, w = e.vectors.to_numpy(), np.array([r.value for r in e.values.orderBy("idx").collect()])
    assert z.shape == (22, 9) and np.allclose(a @ z, z * w[:9]) and np.allclose(w, np.linalg.eigvalsh(a))


def test_index_operations_use_no_single_task(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, 500).astype(float)
    table = spark.createDataFrame([(i, float(x), int(x) % 4) for i, x in enumerate(v)], "idx long, value double, type int").repartition(7)
    perm = shape.sort_index(table)
    assert [r.src for r in perm.sort("pos").collect()] == np.argsort(v, kind="stable").tolist()
    types = shape.stable_partition(table)
    assert [(r.pos, r.src) for r in types.sort("pos").collect()] == list(enumerate(np.argsort(v.astype(int) % 4, kind="stable").tolist()))
    for frame in (perm, types):
        text = frame._jdf.queryExecution().toString()
        assert "Window" not in text and "SinglePartition" not in text
    empty = table.limit(0)
    assert shape.sort_index(empty).collect() == [] and shape.stable_partition(empty).collect() == []


@pytest.mark.parametrize("most", [64 << 20, 8])
def test_runs_are_merged(spark, monkeypatch, most):
    monkeypatch.setattr(shape, "BROADCAST_BYTES", most)
    rng = np.random.default_rng(5)
    runs = [np.sort(rng.integers(0, 20, n)).astype(float) for n in (40, 70)]
    frames = [spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "idx long, value double").repartition(3) for r in runs]
    got = [(r.run, r.src) for r in shape.merge_sorted(*frames).sort("pos").collect()]
    assert got == [(k, i) for _, k, i in sorted((x, k, i) for k, r in enumerate(runs) for i, x in enumerate(r))]


# Order, tile and range.
@pytest.mark.parametrize("n,nb,begin,end", [(10, 3, 0, 4), (10, 3, 1, 3), (10, 3, 1, 2), (10, 10, 0, 1), (10, 5, 0, 0)])
@pytest.mark.parametrize("axis", ["rows", "columns"])
def test_permutation_moves_slices(spark, n, nb, begin, end, axis):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n)) + 1j * rng.standard_normal((n, n))
    lo, hi = begin * nb, min(end * nb, n)
    order = rng.permutation(hi - lo)
    perm = spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "pos long, src long")
    out = shape.permute(TiledMatrix.from_numpy(spark, a, nb, nb), perm, axis, begin, end)
    want = a.copy()
    inner = a[lo:hi, lo:hi]
    want[lo:hi, lo:hi] = inner[order] if axis == "rows" else inner[:, order]
    assert np.allclose(out.to_numpy(), want)
    assert "Generate explode" not in out.tiles._jdf.queryExecution().toString() and "posexplode" not in out.tiles._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["d", "z"])
@pytest.mark.parametrize("m,n,mb,nb", [(23, 23, 5, 5), (6, 4, 1, 2), (9, 9, 20, 20)])
def test_residual_and_orthonormality_in_passes(spark, m, n, mb, nb, kind):
    rng = np.random.default_rng(m)
    d, e, w = rng.standard_normal(m), rng.standard_normal(m - 1), rng.standard_normal(n)
    z = rng.standard_normal((m, n)) + (1j if kind == "z" else 0) * rng.standard_normal((m, n))
    z[mb : 2 * mb, : 2 * nb] = 0
    z[:, nb : 2 * nb] = 0
    a = TiledMatrix.from_numpy(spark, z, mb, nb)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    for q in (a, replace(a, tiles=a.tiles.filter("exists(re, x -> x != 0)"))):  # tiles of zeros needn't be there
        assert np.isclose(D.largest_residual(d, e, w, q), abs(t @ z - z * w).max(), rtol=1e-13)
        for held in (1, 4 * nb * nb, 1 << 20):
            assert np.isclose(D.apart_from_orthonormal(q, held), abs(z.conj().T @ z - np.eye(n)).max(), rtol=1e-13)
    z[m - 1, n - 1] = np.nan
    a = TiledMatrix.from_numpy(spark, z, mb, nb)
    assert np.isnan(D.largest_residual(d, e, w, a)) and np.isnan(D.apart_from_orthonormal(a))


def test_stedc_tiles_moves_no_copies_of_the_vectors(spark, monkeypatch):
    """The eigenvectors were sent to each block of rows of a matrix that is zero off three diagonals, and to all pairs of blocks."""
    monkeypatch.setattr(queries.multiply, "gemm", lambda *a, **k: pytest.fail("the eigenvectors were multiplied as dense operands"))
    d, e = next(m for k, m in enumerate(matrices(300, np.random.default_rng(1))) if k == 2)
    monkeypatch.setattr(queries, "_tridiagonal_of", lambda s, f: (d, e))
    n, trace, squares, residual, apart = queries.QUERIES["stedc_tiles"](spark, "").first()
    assert (n, trace, squares, residual, apart) == (300, d.sum(), (d * d).sum() + 2 * (e * e).sum(), 0, 0)
