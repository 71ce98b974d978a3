import numpy as np
import pytest

from mosaiq.api import ENTRY_POINTS
from mosaiq.functions import spectral as S
from mosaiq.matrix import TiledMatrix
from mosaiq.operators import eigen, factor, multiply
from mosaiq.queries import gram_gemm


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_no_cartesian_products(spark):
    a = TiledMatrix.from_numpy(spark, np.eye(12) * 4, 4, 4)
    panel = a.map_tiles(lambda ti, tj, x: x, keep="tj = 0")
    for frame in (factor._updated(a, panel, 0).tiles, multiply.herk("L", a).tiles):
        assert "Cartesian" not in plan(frame) and "BroadcastNestedLoop" not in plan(frame)
    assert "Join" not in plan(gram_gemm(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("missing", [False, True])
def test_cholesky_fills_in_tiles_that_are_not_there(spark, missing):
    rng = np.random.default_rng(3)
    a = np.eye(14) * 20
    a[:, 0] = a[0] = rng.uniform(1, 2, 14)  # an arrow: its factor is full
    a[0, 0] = 30
    m = TiledMatrix.from_numpy(spark, a, 4, 4)
    if missing:
        m = m.__class__(m.tiles.filter("ti = tj or ti = 0 or tj = 0"), m.m, m.n, m.mb, m.nb, m.dtype)
    low = factor.potrf("L", m, "tiles").to_numpy()
    assert np.allclose(np.tril(low), np.linalg.cholesky(a))


@pytest.mark.parametrize("n,band,kind", [(1, 2, float), (5, 2, float), (37, 9, float), (18, 6, complex), (34, 6, complex)])
def test_bulge_chasing_on_the_band(n, band, kind):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n)) + (1j * rng.standard_normal((n, n)) if kind is complex else 0)
    a = np.where(abs(np.subtract.outer(np.arange(n), np.arange(n))) <= band, a + a.conj().T, 0)
    d, e, reflectors = S.band_to_tridiagonal(a, band)
    q = S.apply_reflectors(reflectors, np.eye(n, dtype=a.dtype))
    assert np.allclose(q @ (np.diag(d) + np.diag(e, 1) + np.diag(e, -1)) @ q.conj().T, a)


def test_back_transformation_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((24, 24))
    m = TiledMatrix.from_numpy(spark, a + a.T, 8, 8)
    monkeypatch.setattr(eigen, "BROADCAST_BYTES", 700)
    monkeypatch.setattr(eigen, "fits_broadcast", lambda *_: True)
    e = eigen.heevd("L", m, strategy="tiles", band=4)
    z, w = e.vectors.to_numpy(), np.array([r.value for r in e.values.orderBy("idx").collect()])
    assert np.allclose(z @ np.diag(w) @ z.T, a + a.T)


def test_entry_points(spark):
    assert len(ENTRY_POINTS) == 64
    rng = np.random.default_rng(2)
    for letter, kind in (("d", "sy"), ("z", "he")):
        a = rng.standard_normal((9, 9)) + (1j * rng.standard_normal((9, 9)) if letter == "z" else 0)
        h, p = a + a.conj().T, a @ a.conj().T + 9 * np.eye(9)
        tiles = lambda x: TiledMatrix.from_numpy(spark, x, 4, 4)
        low, info = ENTRY_POINTS[f"p{letter}potrf"]("L", tiles(p))
        assert info == 0 and np.allclose(np.tril(low.to_numpy()), np.linalg.cholesky(p))
        assert np.allclose(np.tril(ENTRY_POINTS[f"p{letter}potri"]("L", low)[0].to_numpy()), np.tril(np.linalg.inv(p)))
        assert ENTRY_POINTS[f"p{letter}potrf"]("L", tiles(np.diag([1.0, 2, -1, 4, 5, 6, 7, 8, 9]).astype(a.dtype)))[1] == 3
        values = lambda e: [r.value for r in e.values.orderBy("idx").collect()]
        assert np.allclose(values(ENTRY_POINTS[f"p{letter}{kind}evd"]("L", tiles(h))), np.linalg.eigvalsh(h))
        low_inv = np.linalg.inv(np.linalg.cholesky(p))
        want = np.linalg.eigvalsh(low_inv @ h @ low_inv.conj().T)
        word = "symmetric" if kind == "sy" else "hermitian"
        part = ENTRY_POINTS[f"{word}_generalized_eigensolver_partial_spectrum_{letter}"]("L", tiles(h), tiles(p), 0, 3)
        assert np.allclose(values(part)[:3], want[:3]) and part.vectors.n == 3
        part = ENTRY_POINTS[f"{word}_generalized_eigensolver_partial_spectrum_factorized_{letter}"]("L", tiles(h), low, 0, 2)
        z = part.vectors.to_numpy()
        assert np.allclose(z.conj().T @ p @ z, np.eye(2))
        with pytest.raises(TypeError):
            ENTRY_POINTS["pspotrf"]("L", tiles(p))
