import numpy as np
import pytest

from mosaiq import layout as L
from mosaiq.functions import kernels as K
from mosaiq.functions import spectral as S
from mosaiq.plans.strategy import chain_order


def test_index_table():
    axis = L.Axis(16, 3, grid=3, source=1)
    elements = range(16)
    assert [axis.tile_of(e) for e in elements] == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5]
    assert [axis.rank_of_tile(axis.tile_of(e)) for e in elements] == [1] * 3 + [2] * 3 + [0] * 3 + [1] * 3 + [2] * 3 + [0]
    assert [axis.inside_tile(e) for e in elements] == [0, 1, 2] * 5 + [0]
    assert [axis.local_tile(axis.tile_of(e)) for e in elements] == [0] * 9 + [1] * 7
    assert [axis.next_local_tile(axis.tile_of(e), 0) for e in elements] == [0] * 9 + [1] * 7
    assert [axis.next_local_tile(axis.tile_of(e), 1) for e in elements] == [0] * 3 + [1] * 9 + [2] * 4
    assert [axis.next_local_tile(axis.tile_of(e), 2) for e in elements] == [0] * 6 + [1] * 9 + [2]


@pytest.mark.parametrize("axis", [L.Axis(29, 3, 6, 3, 1), L.Axis(29, 3, 6, 2, 1, 4), L.Axis(0, 3), L.Axis(7, 7), L.Axis(20, 2, 4, 3, 0, 9)])
def test_indices_fit_together(axis):
    seen = {}
    for tile in range(axis.tiles):
        rank = axis.rank_of_tile(tile)
        assert axis.local_tile(tile) == seen.get(rank, 0)
        seen[rank] = seen.get(rank, 0) + 1
        assert axis.global_tile(axis.local_tile(tile), rank) == tile
    for element in range(axis.size):
        assert axis.element_of(axis.tile_of(element), axis.inside_tile(element)) == element
    assert sum(axis.tile_size(t) for t in range(axis.tiles)) == axis.size


def test_small_helpers():
    assert L.band_size(256) == 128 and L.band_size(512) == 128 and L.band_size(64) == 64 and L.band_size(6, 3) == 3
    assert L.total_ops("d", 3, 4) == 7 and L.total_ops("z", 3, 4) == 30
    assert L.ceil_div(7, 2) == 4 and L.percent_to_index(10, 25) == 3 and L.same_sign(-1.0, -2.0)
    with pytest.raises(ValueError):
        L.Axis(3, 2, 3)
    flops, order = chain_order([1000, 2, 1000, 3])
    assert order == [0, [1, 2]] and flops == 2 * 2 * 1000 * 3 + 2 * 1000 * 2 * 3


def test_merge_order_covers_all_leaves():
    assert S.merge_order(10) == [(0, 1, 2), (0, 2, 3), (3, 4, 5), (0, 3, 5), (5, 6, 7), (5, 7, 8), (8, 9, 10), (5, 8, 10), (0, 5, 10)]


@pytest.mark.parametrize("kind", "dz")
@pytest.mark.parametrize("n,band", [(1, 2), (2, 2), (5, 5), (13, 3), (34, 6), (42, 12), (70, 8)])
def test_staged_eigensolver(kind, n, band):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, n)) + (1j * rng.standard_normal((n, n)) if kind == "z" else 0)
    a = a + a.conj().T
    w, z = S.staged_eigensolver(np.where(K._mask(a, "L"), a, np.nan), "L", band)
    assert np.allclose(w, np.linalg.eigvalsh(a)) and np.allclose(z.conj().T @ z, np.eye(n)) and np.allclose(a @ z, z * w)


@pytest.mark.parametrize("n", [0, 4, 16, 100, 193])
def test_divide_and_conquer(n):
    k = np.arange(1, n + 1)
    w, z = S.tridiagonal_eigensolver(np.full(n, 2.0), np.full(max(0, n - 1), -1.0))
    assert np.allclose(w, 2 * (1 - np.cos(np.pi * k / (n + 1)))) and np.allclose(z.T @ z, np.eye(n))
    rng = np.random.default_rng(n)
    d, e = rng.integers(0, 3, n).astype(float), rng.integers(-1, 2, max(0, n - 1)).astype(float)
    w, z = S.tridiagonal_eigensolver(d, e)
    dense = np.diag(d) + np.diag(e, 1) + np.diag(e, -1) if n else np.zeros((0, 0))
    assert np.allclose(dense @ z, z * w) and np.allclose(z.T @ z, np.eye(n)) and (np.diff(w) >= 0).all()
