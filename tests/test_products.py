import numpy as np
import pytest

from mosaiq.matrix import TiledMatrix
from mosaiq.operators import multiply as M


def tiled(spark, a, mb, nb):
    return TiledMatrix.from_numpy(spark, a, mb, nb)


def test_outer_product_of_one_inner_tile_uses_many_tasks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((40, 3)), rng.standard_normal((3, 40))
    got = M.gemm(tiled(spark, a, 4, 3), tiled(spark, b, 3, 4))
    assert np.allclose(got.to_numpy(), a @ b)
    sizes = [r["count"] for r in got.tiles.groupBy(M.F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and sum(sizes) == 100 and max(sizes) < 60
    plan = got.tiles._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(gi" in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("held", [8, 200, 4 << 20])
@pytest.mark.parametrize("m,n,k,kind", [(17, 13, 29, "d"), (5, 40, 5, "z"), (30, 4, 50, "d")])
def test_blocks_of_any_size_give_the_product(spark, monkeypatch, held, m, n, k, kind):
    monkeypatch.setattr(M, "HELD", held)
    rng = np.random.default_rng(m)
    draw = lambda *s: rng.standard_normal(s) + (1j * rng.standard_normal(s) if kind == "z" else 0)
    a, b, c = draw(m, k), draw(k, n), draw(m, n)
    assert np.allclose(M.gemm(tiled(spark, a, 4, 5), tiled(spark, b, 5, 3), 2, -1, tiled(spark, c, 4, 3)).to_numpy(), 2 * a @ b - c)


def test_triangles_leave_out_blocks(spark):
    a = np.random.default_rng(3).standard_normal((24, 6))
    for uplo in "LU":
        got = M.herk(uplo, tiled(spark, a, 4, 3))
        assert np.allclose(got.to_numpy(), np.tril(a @ a.T) if uplo == "L" else np.triu(a @ a.T))
        assert got.tiles.count() == 21


@pytest.mark.parametrize("tiles,sizes", [((160, 160, 160), (256, 256, 256)), ((1000, 1000, 1), (256, 256, 256)), ((1, 1, 5000), (256, 256, 256)), ((1, 3, 2), (9000, 9000, 9000)), ((7, 5, 3), (4, 4, 4))])
def test_grid(tiles, sizes):
    i, j, k = M.grid(tiles, sizes, 64)
    assert i * j * k >= min(64, np.prod(tiles))
    held = lambda t, n, u, p, x, y: -(-t // n) * -(-u // p) * x * y
    assert held(tiles[0], i, tiles[1], j, sizes[0], sizes[1]) <= M.HELD or (i, j) == tiles[:2]
    assert held(tiles[0], i, tiles[2], k, sizes[0], sizes[2]) <= M.HELD or (i, k) == (tiles[0], tiles[2])
    if tiles[2] == 5000:
        assert k > 1  # an inner product is cut along its inner size


def test_missing_tiles_are_zeros(spark):
    a = np.zeros((12, 12))
    a[0, 11] = 3
    m = tiled(spark, a, 4, 4)
    m = m.__class__(m.tiles.filter("ti = 0 and tj = 2"), 12, 12, 4, 4)
    assert np.allclose(M.gemm(m, m, opb="T").to_numpy(), a @ a.T) and M.gemm(m, m).to_numpy().sum() == 0
