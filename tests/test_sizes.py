from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq
import pytest

from mosaiq import queries
from mosaiq.functions import spectral as S
from mosaiq.matrix import TiledMatrix
from mosaiq.operators import chase, divide, eigen
from mosaiq.plans import strategy
from mosaiq.sources import generators, storage
from test_divide import matrices


@pytest.mark.parametrize("n,nb,leaf", [(16, 5, 5), (93, 7, 14), (40, 40, None)])
def test_eigenvalues_alone_equal_those_with_vectors(spark, n, nb, leaf):
    for d, e in matrices(n, np.random.default_rng(n)):
        t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
        values = divide.eigenvalues(spark, d, e, nb, leaf)
        assert np.allclose(values, np.linalg.eigvalsh(t), atol=1e-13 * max(1, abs(t).max())) and (np.diff(values) >= 0).all()


def test_eigenvalues_alone_write_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(eigen, "divide_and_conquer", lambda *a: pytest.fail("eigenvectors weren't asked for"))
    monkeypatch.setattr(divide.Scratch, "stored", lambda *a: pytest.fail("a table was written"))
    found = eigen.tridiagonal_eigensolver(spark, np.full(30, 2.0), np.full(29, -1.0), 7, strategy="tiles").values
    assert np.allclose([r.value for r in found.orderBy("idx").collect()], 2 - 2 * np.cos(np.pi * np.arange(1, 31) / 31))


def test_values_and_vectors_of_one_run(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    e = eigen.heevd("L", TiledMatrix.from_numpy(spark, a, 6, 6), strategy="tiles", band=3)
    alone = [r.value for r in e.values.orderBy("idx").collect()]
    z, w = e.vectors.to_numpy(), [r.value for r in e.values.orderBy("idx").collect()]
    assert np.allclose(alone, np.linalg.eigvalsh(a)) and np.allclose(a @ z, z * w)


@pytest.mark.parametrize("reach,steps", [(1, 0), (3, 0), (7, 8)])
def test_panels_inside_the_band_need_no_step(spark, monkeypatch, reach, steps):
    made, step = [], eigen._driver_step
    monkeypatch.setattr(eigen, "_driver_step", lambda a, k, band: (made.append(k), step(a, k, band))[1])
    i, j = np.indices((26, 26))
    a = np.where(abs(i - j) <= reach, np.minimum(i, j) + 1.0, 0)
    banded = eigen.reduction_to_band(TiledMatrix.from_numpy(spark, a, 6, 6), 3)
    tri = eigen.band_to_tridiagonal(banded, 3)
    assert len(made) == steps and (tri.reflectors.frame.count() == 0) == (reach == 1)
    t = np.diag(tri.d) + np.diag(tri.e, 1) + np.diag(tri.e, -1)
    q = eigen.bt_reduction_to_band(eigen.bt_band_to_tridiagonal(generators.identity(spark, 26, 6), tri.reflectors), banded.panels).to_numpy()
    assert np.allclose(q @ t @ q.T, a)


def test_leading_panels_inside_the_band(spark):
    i, j = np.indices((26, 26))
    a = np.where((abs(i - j) <= 2) | (np.minimum(i, j) >= 10), 1.0 + np.minimum(i, j) % 5 + 3 * (i == j), 0)
    m = TiledMatrix.from_numpy(spark, a, 6, 6)
    assert chase.outside_band(m, 3) == 10 and chase.outside_band(m, 30) == 26
    banded = eigen.reduction_to_band(m, 3)
    full, q = banded.matrix.to_numpy(), eigen.bt_reduction_to_band(generators.identity(spark, 26, 6), banded.panels).to_numpy()
    assert np.allclose(np.where(abs(i - j) > 3, full, 0), 0) and np.allclose(q @ full @ q.T, a)


def test_a_task_isnt_given_more_than_it_holds(monkeypatch):
    assert strategy.single_task(strategy.TASK_MAX, force="task") and not strategy.single_task(strategy.TASK_MAX + 1, force="task")
    assert strategy.single_task(2048) and not strategy.single_task(2049) and not strategy.single_task(1, force="tiles")
    with pytest.raises(ValueError):
        strategy.single_task(1, force="driver")


def test_laplace_has_no_tiles_of_zeros(spark):
    a = queries._laplace(spark, 50, 6)
    want = 2 * np.eye(50) - np.eye(50, k=1) - np.eye(50, k=-1)
    assert a.tiles.count() == 9 + 8 + 8 and np.array_equal(a.to_numpy(), want)


@pytest.mark.parametrize("kind", ["d", "z"])
def test_generated_tiles_are_checked_where_they_are_made(spark, kind):
    a = generators.random_hermitian(spark, 40, 6, 0, kind)
    found = queries._checked(a, 0, 1.0)
    assert "posexplode" not in (plan := found._jdf.queryExecution().toString()) and "array<double>" not in plan
    assert tuple(found.first()) == (1600, True, False)
    x = a.to_numpy()
    assert np.allclose(x, x.conj().T) and (kind == "d" or abs(x.imag).max() > 0.1)
    # Matrices that come from tables, and elements that don't fit, are seen too.
    assert tuple(queries._checked(a.map_tiles(lambda ti, tj, t: 1j * t if kind == "z" else t), 0, 0.5).first()) == (1600, False, kind == "z")
    assert tuple(queries._checked(generators.random(spark, 0, 3, 2, 2), 0, 1).first())[0] == 0


def test_banded_and_diagonal_tiles(spark):
    band = generators.random_hermitian(spark, 50, 6, band=7)
    whole = generators.random_hermitian(spark, 50, 6)
    i, j = np.indices((50, 50))
    assert np.array_equal(band.to_numpy(), np.where(abs(i - j) <= 7, whole.to_numpy(), 0)) and band.tiles.count() < 50
    a = generators.random_non_zero_diagonal(spark, 50, 6)
    assert [r.re for r in a.diagonal().orderBy("i").collect()] == np.diag(a.to_numpy()).tolist()
    x = np.arange(35.0).reshape(7, 5)
    assert [tuple(r) for r in TiledMatrix.from_numpy(spark, x, 2, 3).diagonal().orderBy("i").collect()] == [(k, 6.0 * k, 0.0) for k in range(5)]


@pytest.mark.parametrize("f", [lambda i, j: np.sin(i + 100.0 * j), lambda i, j: 0.0 * (i + j)])
def test_tables_of_tiles_have_small_row_groups(spark, tmp_path, f):
    """A reader unpacks a row group at once: 300 tiles of 80 kB were one, and of zeros any number of tiles."""
    a = TiledMatrix.generate(spark, 100, 30_000, 100, 100, f)
    a = replace(a, tiles=a.tiles.coalesce(1))
    with strategy.Scratch(spark) as scratch:
        storage.write(a, str(tmp_path), "a")
        for frame in (strategy.stored(a.tiles), scratch.stored(a.tiles), storage.read(spark, str(tmp_path), "a").tiles):
            (file,) = (f.removeprefix("file:").removeprefix("//") for f in frame.inputFiles())
            meta = pq.ParquetFile(file).metadata
            groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
            assert meta.num_rows == 300 and max(g.num_rows for g in groups) <= strategy.ROW_GROUP_ROWS
            assert max(g.total_byte_size for g in groups) < 1.2 * strategy.ROW_GROUP_BYTES


def spectra(k, rng):
    yield np.sort(rng.uniform(-2, 2, k)), rng.standard_normal(k)
    yield 2 - 2 * np.cos(np.pi * np.arange(1, k + 1) / (k + 1)), np.ones(k)
    yield np.cumsum(10.0 ** rng.uniform(-11, 0, k)), 10.0 ** rng.uniform(-6, 0, k)
    yield np.sort(np.concatenate((rng.uniform(0, 1e-9, k // 2), 1 + rng.uniform(0, 50, k - k // 2)))), rng.standard_normal(k)


@pytest.mark.parametrize("kind", range(4))
def test_far_poles_are_summed_at_a_few_points(kind, monkeypatch):
    k, rng = 1500, np.random.default_rng(kind)
    d, z = list(spectra(k, rng))[kind]
    rho, rows = 0.7, rng.standard_normal((2, k))
    every = [(lo, min(lo + 400, k)) for lo in range(0, k, 400)]

    def run():
        pole, x = (np.concatenate(v) for v in zip(*(S.secular_range(d, z, rho, *r) for r in every), strict=True))
        logs = np.concatenate([S.range_of_weight_logs(d, rho, pole, x, *r) for r in every])
        weight = np.copysign(np.exp(logs / 2), z)
        return pole, x, logs, weight, np.hstack([S.range_of_rows(d, weight, rows, pole, x, *r) for r in every])

    direct = run()
    assert np.allclose(direct[2], S.weight_logs(d, rho, 0, *direct[:2]), rtol=0, atol=1e-11) and np.allclose(direct[3], z, rtol=1e-6)
    u = direct[3][:, None] / ((d[:, None] - d[direct[0]]) - direct[1])
    assert np.allclose(rows @ (u / np.linalg.norm(u, axis=0)), direct[4], rtol=0, atol=1e-12)
    monkeypatch.setattr(S, "ROOTS", 16)
    monkeypatch.setattr(S, "WEIGHTS", 32)
    near = list(S.intervals(d, d[-1] + rho * (z @ z), 0, k, 16))
    assert [x for n in near for x in range(n.lo, n.hi)] == list(range(k))
    # Few poles are near: a direct sum has k for each root.
    assert sum((n.hi - n.lo) * (n.end - n.first) for n in near) < 0.2 * k * k
    pole, x, logs, weight, values = run()
    assert np.array_equal(pole, direct[0]) and np.allclose(x, direct[1], rtol=1e-10, atol=1e-15 * abs(d).max())
    assert np.allclose(logs, direct[2], rtol=0, atol=1e-10) and np.allclose(values, direct[4], rtol=0, atol=1e-10)


def test_eigenvalues_alone_take_no_table_of_all_differences(spark, monkeypatch):
    """Each level made the differences of all poles and roots, n x n at the last."""
    monkeypatch.setattr(divide, "solve_secular", lambda *a: pytest.fail("all differences were made"))
    monkeypatch.setattr(S, "ROOTS", 16)
    n, rng = 700, np.random.default_rng(5)
    for d, e in ((np.full(n, 2.0), np.full(n - 1, -1.0)), (rng.standard_normal(n), rng.standard_normal(n - 1))):
        values = divide.eigenvalues(spark, d, e, 35, 70)
        assert np.allclose(values, np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1)), rtol=0, atol=1e-13)


@pytest.mark.parametrize("n", [3, 10, 40, 48])
def test_a_tile_and_its_mirror_are_drawn_once(spark, monkeypatch, n):
    drawn, draw, t = spark.sparkContext.accumulator(0), generators._draw, -(-n // 6)
    monkeypatch.setattr(generators, "_draw", lambda *a: (drawn.add(1), draw(*a))[1])
    a = generators.random_hermitian(spark, n, 6, 3.0, "z")
    assert tuple(queries._checked(a, 0, 4.0).first()) == (n * n, True, False)
    assert drawn.value == t * (t + 1) // 2
    x = a.to_numpy()
    assert np.array_equal(x, x.conj().T) and (x != 0).all() and a.tiles.count() == t * t
    assert [r.re for r in a.diagonal().orderBy("i").collect()] == np.diag(x).real.tolist()
    for i, j in ((0, 0), (t - 1, 0)):  # a tile depends on its place only
        place = np.arange(6 * i, min(n, 6 * i + 6))[:, None], np.arange(6 * j, min(n, 6 * j + 6))[None, :]
        off = place[0] > place[1]
        assert np.array_equal(np.where(off, draw(*place, n, True), 0), np.where(off, x[np.ix_(place[0][:, 0], place[1][0])], 0))


def test_draws_in_the_unit_disc():
    rng = np.random.default_rng(1)
    squares, turns = rng.random(5000), np.concatenate((rng.random(4990), np.arange(10) / 8 % 1))
    generators._in_disc(squares, turns, out := np.empty(5000, complex))
    assert np.allclose(out, np.sqrt(squares) * np.exp(2j * np.pi * turns), rtol=0, atol=2e-15) and (abs(out) <= 1).all()


def test_elements_outside_of_the_limits_are_seen(spark):
    x = np.full((7, 7), 0.5)
    for kind, bad in ((1, 1.5), (1j, 1.5), (1, np.nan), (1j, np.nan), (1, 0.1)):
        y = x * kind
        y[6, 2] = bad * kind
        assert tuple(queries._checked(TiledMatrix.from_numpy(spark, y, 3, 3), 0.2, 1.0).first())[:2] == (49, False)
        assert tuple(queries._checked(TiledMatrix.from_numpy(spark, x * kind, 3, 3), 0.2, 1.0).first())[:2] == (49, True)
