import numpy as np
import pytest

from mosaiq.functions import kernels as K
from mosaiq.functions import spectral as S
from mosaiq.matrix import TiledMatrix
from mosaiq.operators import chase as C
from mosaiq.operators import eigen, panel


def hermitian(n, kind, band=None, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((n, n)) + (1j * rng.standard_normal((n, n)) if kind is complex else 0)
    a = a + a.conj().T
    return a if band is None else np.where(abs(np.subtract.outer(np.arange(n), np.arange(n))) <= band, a, 0)


# Order, tile and band.
@pytest.mark.parametrize("n,nb,band,kind,group", [(1, 2, 2, float, None), (5, 5, 5, complex, None), (16, 12, 6, float, 3), (37, 9, 3, complex, 5), (30, 10, 2, float, 2)])
def test_wavefront_equals_one_chase(spark, n, nb, band, kind, group):
    a = hermitian(n, kind, band, n)
    t = eigen.band_to_tridiagonal(TiledMatrix.from_numpy(spark, a, nb, nb), band, group)
    d, e, _ = S.band_to_tridiagonal(a, band)
    assert np.allclose(t.d, d) and np.allclose(t.e, e)
    q = eigen.bt_band_to_tridiagonal(TiledMatrix.from_numpy(spark, np.eye(n), nb, nb), t.reflectors).to_numpy()
    assert np.allclose(q @ (np.diag(t.d) + np.diag(t.e, 1) + np.diag(t.e, -1)) @ q.conj().T, a)


@pytest.mark.parametrize("n,band,group", [(300, 3, 2), (97, 2, 4), (64, 5, 1), (50, 4, 30)])
def test_windows_of_a_wave_are_apart_and_in_order(n, band, group):
    """Steps are made once each, and never before the steps of earlier sweeps that they need."""
    count = n - 2
    width = band * (2 * group + 3)
    made, most = {}, 0
    for wave in range(2 * count + n):
        work = sorted(C.windows(wave, n, band, group, count), key=lambda w: w[2])
        most = max(most, len(work))
        assert all(a[3] <= b[2] and a[3] % band == b[2] % band == 0 for a, b in zip(work, work[1:], strict=False))
        fresh = []
        for g, p, lo, hi in work:
            for sweep in range(g * group, min(count, (g + 1) * group)):
                skew = 2 * band * (sweep - g * group)
                for row in range(sweep + 1, n, band):
                    if p * width <= row + skew < (p + 1) * width:
                        assert lo <= max(0, row - band) and min(n, row + 2 * band) <= hi
                        fresh.append((sweep, row))
        for step in fresh:
            made[step] = wave
    assert len(made) == sum(len(range(s + 1, n, band)) for s in range(count))
    for (sweep, row), wave in made.items():
        if sweep:
            for before in range(sweep, row + 2 * band, band):
                if (sweep - 1, before) in made:
                    assert made[sweep - 1, before] <= wave and (sweep % group or made[sweep - 1, before] < wave)
    assert most > 1 or width >= n / 3


def test_reflectors_are_a_dataset(spark):
    t = eigen.band_to_tridiagonal(TiledMatrix.from_numpy(spark, hermitian(26, float, 2), 6, 6), 2, 3)
    assert t.reflectors.frame.count() == sum(len(range(s + 1, 25, 2)) for s in range(24)) and len(t.d) == 26 and len(t.e) == 25
    blocks = C.blocks_of(t.reflectors, 2)
    assert blocks.filter("tj = 1").count() < t.reflectors.frame.count()
    e = C.apply_steps(TiledMatrix.from_numpy(spark, np.eye(26), 6, 6), blocks, False)
    shuffles = [x for x in e.tiles._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(shuffles) == 2 and any("hashpartitioning(col" in x for x in shuffles)  # one more groups the reflectors


@pytest.mark.parametrize("n,nb,band,kind", [(26, 4, 2, float), (23, 6, 3, complex)])
def test_band_reduction_by_trees(spark, monkeypatch, n, nb, band, kind):
    monkeypatch.setattr(panel, "FAN", 3)
    a = hermitian(n, kind, seed=n)
    got = eigen.reduction_to_band(TiledMatrix.from_numpy(spark, a, nb, nb), band, held=band * 8)
    b = got.matrix.to_numpy()
    assert np.allclose(b, np.where(abs(np.subtract.outer(np.arange(n), np.arange(n))) <= band, b, 0)) and np.allclose(b, b.conj().T)
    q = eigen.bt_reduction_to_band(TiledMatrix.from_numpy(spark, np.eye(n), nb, nb), got.panels).to_numpy()
    assert np.allclose(q @ b @ q.conj().T, a) and np.allclose(q @ q.conj().T, np.eye(n))


@pytest.mark.parametrize("kind", [float, complex])
def test_tall_qr(spark, monkeypatch, kind):
    monkeypatch.setattr(panel, "FAN", 2)
    rng = np.random.default_rng(1)
    a = rng.standard_normal((37, 4)) + (1j * rng.standard_normal((37, 4)) if kind is complex else 0)
    a[5:20] = 0  # a tile of zeros
    v, t, r = panel.tall_skinny_qr(TiledMatrix.from_numpy(spark, a, 5, 4))
    v = v.to_numpy()
    h = np.eye(37) - v @ t @ v.conj().T
    assert np.allclose(h @ np.vstack((r, np.zeros((33, 4)))), a) and np.allclose(h @ h.conj().T, np.eye(37))
    assert np.allclose(np.tril(v[:4]), v[:4]) and np.allclose(np.diag(v), 1)


def test_reconstructed_reflectors():
    for seed in range(5):
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((9, 4)))[0]
        low, upper, signs = panel.reconstruct(q[:4])
        assert np.allclose(low @ upper, np.eye(4) - q[:4] * signs) and (abs(np.diag(upper)) >= 1 - 1e-12).all()
    low, upper, signs = panel.reconstruct(np.eye(4))
    assert np.allclose(low @ upper, 2 * np.eye(4))
    assert K.larft(np.eye(4), np.full(4, 2.0)).tolist() == (2 * np.eye(4)).tolist()
