import numpy as np
import pytest

from mosaiq.functions import kernels as K
from mosaiq.matrix import TiledMatrix
from mosaiq.operators import eigen, factor, multiply, shape, solve
from mosaiq.sources import generators as G
from mosaiq.sources import storage

RNG = np.random.default_rng(5)


def dense(m, n, kind="d"):
    a = RNG.uniform(-1, 1, (m, n))
    return a + 1j * RNG.uniform(-1, 1, (m, n)) if kind == "z" else a


def hermitian(n, kind="d", offset=0.0):
    a = dense(n, n, kind)
    return a + a.conj().T + offset * np.eye(n)


def tiled(spark, a, mb, nb=None):
    return TiledMatrix.from_numpy(spark, a, mb, nb or mb)


def poison(a, uplo):
    return np.where(K._mask(a, uplo), a, np.nan)


@pytest.mark.parametrize("kind,m,n,k", [("d", 26, 13, 7), ("z", 12, 20, 11), ("d", 0, 4, 3), ("d", 5, 4, 0)])
def test_gemm(spark, kind, m, n, k):
    a, b, c = dense(m, k, kind), dense(k, n, kind), dense(m, n, kind)
    got = multiply.gemm(tiled(spark, a, 4, 3), tiled(spark, b, 3, 5), 2.0, -0.5, tiled(spark, c, 4, 5)).to_numpy()
    assert np.allclose(got, 2 * a @ b - 0.5 * c)


def test_gemm_takes_transposes_and_chains(spark):
    a, b, c = dense(7, 9, "z"), dense(7, 5, "z"), dense(5, 11, "z")
    assert np.allclose(multiply.gemm(tiled(spark, a, 3), tiled(spark, b, 3), opa="C").to_numpy(), a.conj().T @ b)
    assert np.allclose(multiply.chain(tiled(spark, a.T, 3), tiled(spark, b, 3), tiled(spark, c, 3)).to_numpy(), a.T @ b @ c)


@pytest.mark.parametrize("side,uplo,kind", [("L", "L", "d"), ("L", "U", "z"), ("R", "L", "z"), ("R", "U", "d")])
def test_hemm_reads_one_triangle(spark, side, uplo, kind):
    h = hermitian(10, kind)
    b = dense(10, 6, kind) if side == "L" else dense(6, 10, kind)
    got = multiply.hemm(side, uplo, tiled(spark, poison(h, uplo), 4), tiled(spark, b, 4), 1.5).to_numpy()
    assert np.allclose(got, 1.5 * (h @ b if side == "L" else b @ h))


@pytest.mark.parametrize("side", "LR")
@pytest.mark.parametrize("uplo,op,diag", [("L", "N", "N"), ("L", "C", "U"), ("U", "T", "N"), ("U", "N", "U")])
def test_triangular_multiply_and_solve_undo_each_other(spark, side, uplo, op, diag):
    a = dense(13, 13, "z") * 0.3 + 2 * np.eye(13)
    x = dense(13, 7, "z") if side == "L" else dense(7, 13, "z")
    ta, tx = tiled(spark, poison(a, uplo), 5), tiled(spark, x, 5)
    b = multiply.trmm(side, uplo, op, diag, ta, tx, 2.0)
    assert np.allclose(b.to_numpy(), K.trmm(side, uplo, op, diag, a, x, 2.0))
    for strategy in ("task", "tiles"):
        assert np.allclose(solve.trsm(side, uplo, op, diag, ta, b, 0.5, strategy).to_numpy(), x)


def test_solve_by_steps_when_the_matrix_may_not_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(solve, "fits_broadcast", lambda *a: False)
    for side, uplo, op in (("L", "L", "N"), ("R", "U", "N"), ("L", "U", "N"), ("R", "L", "C")):
        a, b = dense(9, 9, "z") + 4 * np.eye(9), dense(9, 4, "z") if side == "L" else dense(4, 9, "z")
        got = solve.trsm(side, uplo, op, "N", tiled(spark, poison(a, uplo), 4), tiled(spark, b, 4), 2.0, "tiles").to_numpy()
        assert np.allclose(got, K.trsm(side, uplo, op, "N", a, b, 2.0))


def test_solve_with_alpha_zero_is_zero(spark):
    a = tiled(spark, np.eye(4), 2)
    assert not solve.trsm("L", "L", "N", "N", a, a, 0).to_numpy().any()


@pytest.mark.parametrize("kind", "dz")
@pytest.mark.parametrize("uplo", "LU")
@pytest.mark.parametrize("strategy", ["task", "tiles"])
def test_cholesky_inverse_and_reduction(spark, kind, uplo, strategy):
    n = 11
    a, b = hermitian(n, kind), hermitian(n, kind, 2 * n)
    f = factor.potrf(uplo, tiled(spark, poison(b, uplo), 4), strategy)
    t = f.to_numpy()
    assert np.allclose(t, K.triangle(np.linalg.cholesky(b) if uplo == "L" else np.linalg.cholesky(b).conj().T, uplo))
    inverse = solve.potri(uplo, f, strategy).to_numpy()
    assert np.allclose(inverse, K.triangle(np.linalg.inv(b), uplo))
    assert np.allclose(solve.trtri(uplo, "N", f, strategy).to_numpy(), np.linalg.inv(t))
    low = t if uplo == "L" else t.conj().T
    want = np.linalg.inv(low) @ a @ np.linalg.inv(low).conj().T
    assert np.allclose(solve.hegst(uplo, tiled(spark, poison(a, uplo), 4), f, strategy).to_numpy(), K.triangle(want, uplo))


def test_cholesky_of_dyadic_closed_form_and_failure(spark):
    n = 16
    f = lambda i, j: (4.0 ** (np.minimum(i, j) + 1) - 1) / (3 * 2.0 ** (i + j))
    a = TiledMatrix.generate(spark, n, n, 5, 5, f)
    k = np.arange(n)
    want = np.tril(2.0 ** -abs(k[:, None] - k))
    for strategy in ("task", "tiles"):
        assert np.array_equal(factor.potrf("L", a, strategy).to_numpy(), want)
    bad = np.eye(6)
    bad[4, 4] = -1
    with pytest.raises(factor.NotPositiveDefinite):
        factor.potrf("L", tiled(spark, bad, 2), "tiles")
    assert K.potrf_info("L", bad)[1] == 5


@pytest.mark.parametrize("kind,uplo,strategy", [("d", "L", "task"), ("z", "U", "task"), ("d", "U", "tiles"), ("z", "L", "tiles")])
def test_eigensolvers(spark, kind, uplo, strategy):
    n = 12
    a, b = hermitian(n, kind), hermitian(n, kind, 2 * n)
    ta, tb = tiled(spark, poison(a, uplo), 4), tiled(spark, poison(b, uplo), 4)
    e = eigen.heevd(uplo, ta, strategy=strategy)
    w, z = np.array([r.value for r in e.values.orderBy("idx").collect()]), e.vectors.to_numpy()
    assert np.allclose(w, np.linalg.eigvalsh(a)) and np.allclose(z.conj().T @ z, np.eye(n)) and np.allclose(a @ z, z * w)
    part = eigen.heevd(uplo, ta, end=5, strategy=strategy)
    assert part.vectors.to_numpy().shape == (n, 5) and part.values.count() == n
    g = eigen.hegvd(uplo, ta, tb, strategy=strategy)
    w, z = np.array([r.value for r in g.values.orderBy("idx").collect()]), g.vectors.to_numpy()
    assert np.allclose(z.conj().T @ b @ z, np.eye(n)) and np.allclose(a @ z, b @ z * w)


def test_shapes(spark):
    a = dense(23, 17)
    t = tiled(spark, a, 5, 4)
    assert np.array_equal(t.retile(3, 7).to_numpy(), a)
    assert np.array_equal(t.submatrix(3, 2, 15, 9).to_numpy(), a[3:18, 2:11])
    assert np.array_equal(t.submatrix(5, 4, 10, 8).to_numpy(), a[5:15, 4:12])
    assert np.array_equal(t.transpose().to_numpy(), a.T)
    assert np.array_equal(TiledMatrix.from_coo(t.to_coo(), 23, 17, 4, 6).to_numpy(), a)
    want = a.copy()
    want[2:6, 7:10] = a[:4, :3]
    assert np.allclose(shape.paste(t.submatrix(0, 0, 4, 3), t, (2, 7)).to_numpy(), want)
    assert shape.max_norm(t) == np.abs(a).max() and shape.max_norm(tiled(spark, a[:17], 4), "L") == np.abs(np.tril(a[:17])).max()
    perm = spark.createDataFrame([(p, 9 - p) for p in range(10)], "pos long, src long")
    square = dense(23, 23)
    want = square.copy()
    want[5:15, 5:15] = square[5:15, 5:15][:, ::-1]
    assert np.array_equal(shape.permute(tiled(spark, square, 5), perm, "columns", 1, 3).to_numpy(), want)


def test_random_matrices_do_not_depend_on_partitions(spark):
    a = G.random_positive_definite(spark, 14, 4, "z").to_numpy()
    assert np.allclose(a, a.conj().T) and np.linalg.eigvalsh(a).min() > 0
    b = G.random_hermitian(spark, 14, 4, band=2).to_numpy()
    assert not np.triu(b, 3).any() and np.allclose(b, b.T)
    assert np.all(np.abs(np.diag(G.random_non_zero_diagonal(spark, 9, 4).to_numpy())) >= 0.1)


def test_storage_and_text(spark, tmp_path):
    a = dense(9, 7, "z")
    t = tiled(spark, a, 4, 3)
    storage.write(t, str(tmp_path), "a")
    assert np.array_equal(storage.read(spark, str(tmp_path), "a", (5, 2), "z").to_numpy(), a)
    with pytest.raises(TypeError):
        storage.read(spark, str(tmp_path), "a", dtype="d")
    with pytest.raises(Exception, match="exists"):
        storage.write(t, str(tmp_path), "a")
    scope = {"np": np}
    exec(storage.to_numpy_code(t), scope)
    assert np.array_equal(scope["mat"], a)
    assert storage.to_csv(tiled(spark, np.array([[1.5, 2.0]]), 1)) == "1.5,2,\n"
