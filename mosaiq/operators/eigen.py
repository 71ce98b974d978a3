"""Hermitian and generalized Hermitian eigensolvers, and their stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import spectral as S
from ..layout import band_size, require
from ..matrix import TILE, Tile, TiledMatrix, in_one_task, pack, packed, summed, unpack
from ..plans.strategy import BROADCAST_BYTES, Scratch, fits_broadcast, shared_dir, single_task, written
from .chase import Reflectors, apply_steps, blocks_of, chase_bulges, outside_band
from .divide import divide_and_conquer, eigenvalues
from .factor import potrf
from .panel import block_reflector
from .solve import hegst, trsm


#: Numbers of a panel that may go through the driver.
PANEL_HELD = 1 << 20


class Eigen:
    """Eigenvalues (idx, value), ascending, and eigenvectors; what isn't asked for isn't computed.

    Asked for first, the values come without vectors; with or after the vectors, both come from one run.
    """

    def __init__(self, both: Callable[[], tuple[DataFrame, TiledMatrix]], values: Callable[[], DataFrame] | None = None):
        self._solve, self._solve_values = both, values
        self._both: tuple[DataFrame, TiledMatrix] | None = None
        self._alone: DataFrame | None = None

    def _pair(self) -> tuple[DataFrame, TiledMatrix]:
        if self._both is None:
            self._both = self._solve()
        return self._both

    @property
    def values(self) -> DataFrame:
        if self._both is not None or self._solve_values is None:
            return self._pair()[0]
        if self._alone is None:
            self._alone = self._solve_values()
        return self._alone

    @property
    def vectors(self) -> TiledMatrix:
        return self._pair()[1]

    def __iter__(self) -> Iterator[DataFrame | TiledMatrix]:
        return iter(self._pair())


class Band(NamedTuple):
    matrix: TiledMatrix
    panels: list[tuple[int, np.ndarray, np.ndarray]] | DataFrame


class Tridiagonal(NamedTuple):
    d: np.ndarray
    e: np.ndarray
    reflectors: Reflectors


def _values(spark: SparkSession, w: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"idx": pa.array(range(len(w)), pa.int64()), "value": pa.array(np.asarray(w, float))}), "idx long, value double")


def _column(vector: TiledMatrix) -> DataFrame:
    return vector.to_coo().selectExpr("i idx", "re value")


def reduction_to_band(a: TiledMatrix, band: int | None = None, held: int | None = None) -> Band:
    """Qᴴ A Q with a band; A is full and stays in its tiles.

    A panel of up to ``held`` (``PANEL_HELD``) numbers goes through the driver. A larger one is factored by a tree of tasks, and only
    band x band numbers come to the driver in each step; the panels of Q are a dataset then. Leading panels that lie within the band
    already need no step.
    """
    band = band or band_size(a.nb)
    require(a.m == a.n and a.mb == a.nb and band >= 2 and a.nb % band == 0, "square tiles that the band divides are needed")
    n, panels, held = a.n, [], PANEL_HELD if held is None else held
    require(fits_broadcast(1, held, a.dtype), "what goes through the driver is broadcast, too")
    with Scratch(a.spark) as scratch:
        folder = f"{shared_dir(a.spark)}/panels-{uuid.uuid4().hex}"
        steps = range(outside_band(a, band) // band * band, max(0, n - band - 1), band)
        in_tree = [k for k in steps if (n - k - band) * band > max(held, band * band)]
        a = replace(a, tiles=scratch.stored(_filled(a).tiles if in_tree else a.tiles))
        for k in steps:
            if k in in_tree:
                a = _tree_step(a, scratch, k, band, folder)
                scratch.drop_before()
                continue
            a, panel = _driver_step(a, k, band)
            a = replace(a, tiles=scratch.stored(a.tiles))
            scratch.drop_before()
            panels.append(panel)
        a = a.stored("band")
    if not in_tree:
        return Band(a, panels)
    for first, v, taus in panels:
        _keep(a.spark.createDataFrame(pa.Table.from_batches([pack([(first, 0, v)], a.complex)]), TILE), K.larft(v, taus), first, folder, a.complex)
    return Band(a, a.spark.read.schema(f"{TILE}, seq long").parquet(folder))


def _filled(a: TiledMatrix) -> TiledMatrix:
    """Tiles of zeros are there too."""
    zeros = TiledMatrix.generate(a.spark, a.m, a.n, a.mb, a.nb, lambda i, j: np.zeros((i.size, j.size)), a.dtype)
    return replace(a, tiles=a.tiles.unionAll(zeros.tiles.join(a.tiles.select("ti", "tj"), ["ti", "tj"], "left_anti").select(*a.tiles.columns)))


def _keep(v: DataFrame, t: np.ndarray, first: int, folder: str, complex_: bool) -> None:
    """A panel's pieces and its factor, as steps: the last panel comes first."""
    factor = v.sparkSession.createDataFrame(pa.Table.from_batches([pack([(first, 1, t)], complex_)]), TILE)
    written(v.select("ti", F.lit(0).cast("long").alias("tj"), "nr", "nc", "re", "im").unionAll(factor).withColumn("seq", F.lit(-first).cast("long") + (1 << 40)), folder, "append")


def _with_corner(y: np.ndarray, i: np.ndarray, j: np.ndarray, k: int, first: int, corner: np.ndarray) -> np.ndarray:
    """The panel and its mirror: the corner, and zeros below it."""
    for rows, columns, turn in ((i, j, False), (j, i, True)):
        inside, below = np.flatnonzero((columns >= k) & (columns < first)), np.flatnonzero(rows >= first)
        if len(inside) and len(below):
            at = rows[below] - first
            new = np.where((at < len(corner))[:, None], corner[np.minimum(at, len(corner) - 1)][:, columns[inside] - k], 0)
            if turn:
                y[np.ix_(inside, below)] = new.conj().T
            else:
                y[np.ix_(below, inside)] = new
    return y


def _tree_step(a: TiledMatrix, scratch: Scratch, k: int, band: int, folder: str) -> TiledMatrix:
    """One step of the band reduction, with the panel's vectors in strips."""
    n, nb, first, complex_ = a.n, a.nb, k + band, a.complex
    top, left = first // nb, k % nb
    cut = lambda ti: max(0, first - ti * nb)
    strips = a.map_tiles(lambda ti, tj, x: x[cut(ti) :, left : left + band], keep=f"tj = {k // nb} and ti >= {top}", move=lambda ti, tj: (ti - top, 0))
    v, t, corner = block_reflector(scratch, strips.tiles, a.rows.tiles - top, band, complex_)
    inner = a.tiles.filter(f"ti >= {top} and tj >= {top}")
    named = lambda frame, key, p: frame.select((F.col("ti") + top).alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("nr", "nc", "re", "im")))
    tile = lambda p, i, j: [f"{i} {p}_i", f"{j} {p}_j", *(f"{p}_{c}" for c in ("nr", "nc", "re", "im"))]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((ti - top, 0, x[cut(ti) :, cut(tj) :] @ (y @ t)) for batch in batches for (ti, tj, x), (_, _, y) in zip(unpack(batch), unpack(batch, 6), strict=True)), complex_)

    x = scratch.stored(summed(inner.join(named(v, "tj", "v"), "tj").selectExpr(*a.tiles.columns, *tile("v", "tj", "0L")).mapInArrow(products, TILE), complex_))
    both = v.select("ti", F.lit(0).cast("long").alias("tj"), "nr", "nc", "re", "im").join(x.select("ti", *(F.col(c).alias(f"x_{c}") for c in ("nr", "nc", "re", "im"))), "ti").selectExpr(*v.columns, *tile("x", "ti", "0L"))

    def inner_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((0, 0, (y @ t).conj().T @ z) for batch in batches for (_, _, y), (_, _, z) in zip(unpack(batch), unpack(batch, 6), strict=True)), complex_)

    g = sum(z for batch in summed(both.mapInArrow(inner_products, TILE), complex_).toArrow().to_batches() for _, _, z in unpack(batch))

    def side_by_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((ti, 0, np.hstack((y, z - 0.5 * y @ g))) for batch in batches for (ti, _, y), (_, _, z) in zip(unpack(batch), unpack(batch, 6), strict=True)), complex_)

    pair = scratch.stored(both.mapInArrow(side_by_side, TILE))
    meeting = inner.join(named(pair, "ti", "l"), "ti").join(named(pair, "tj", "r"), "tj").selectExpr(*a.tiles.columns, *tile("l", "ti", "0L"), *tile("r", "tj", "0L"))

    def updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Tile]:
            for batch in batches:
                for (ti, tj, y), (_, _, p), (_, _, q) in zip(unpack(batch), unpack(batch, 6), unpack(batch, 12), strict=True):
                    y = y.copy()
                    y[cut(ti) :, cut(tj) :] -= p @ np.hstack((q[:, band:], q[:, :band])).conj().T
                    yield ti, tj, with_corner(ti, tj, y)

        yield from packed(out(), complex_)

    def with_corner(ti: int, tj: int, y: np.ndarray) -> np.ndarray:
        return _with_corner(y, np.arange(ti * nb, ti * nb + y.shape[0]), np.arange(tj * nb, tj * nb + y.shape[1]), k, first, corner)

    rest = replace(a, tiles=a.tiles.filter(f"ti < {top} or tj < {top}")).map_tiles(lambda ti, tj, y: with_corner(ti, tj, y.copy()))
    _keep(v.withColumn("ti", F.greatest(F.lit(first), (F.col("ti") + top) * nb).cast("long")), t, first, folder, complex_)
    return replace(a, tiles=scratch.stored(meeting.mapInArrow(updated, TILE).unionAll(rest.tiles)))


def _driver_step(a: TiledMatrix, k: int, band: int) -> tuple[TiledMatrix, tuple[int, np.ndarray, np.ndarray]]:
    """One step of the band reduction, with the panel (n x band) on the driver; V and A V T are sent to the tasks."""
    spark, n, nb, first = a.spark, a.n, a.nb, k + band
    v, taus, r = K.householder_panel(a.submatrix(first, k, n - first, band).to_numpy())
    whole = np.zeros((n, v.shape[1]), v.dtype)
    whole[first:] = v
    w = whole @ K.larft(v, taus)
    sent, w_sent = spark.sparkContext.broadcast(whole), spark.sparkContext.broadcast(w)
    strip = a.map_tiles(lambda ti, tj, x: x @ w_sent.value[tj * nb : tj * nb + x.shape[1]], keep=f"(ti + 1) * {nb} > {first} and (tj + 1) * {nb} > {first}")
    x = np.zeros_like(w)
    # One sum for each row of tiles comes to the driver: n x band numbers.
    for batch in summed(strip.tiles.withColumn("tj", F.lit(0).cast("long")), np.iscomplexobj(w) or a.complex).toArrow().to_batches():
        for ti, _, part in unpack(batch):
            x[ti * nb : ti * nb + part.shape[0]] += part
    x[:first] = 0
    x = x - 0.5 * whole @ (w.conj().T @ x)
    x_sent, corner = spark.sparkContext.broadcast(x), r[: min(band, len(r))]

    def updated(ti: int, tj: int, y: np.ndarray) -> np.ndarray:
        i, j = np.arange(ti * nb, ti * nb + y.shape[0]), np.arange(tj * nb, tj * nb + y.shape[1])
        y = y - x_sent.value[i] @ sent.value[j].conj().T - sent.value[i] @ x_sent.value[j].conj().T
        return _with_corner(y, i, j, k, first, corner)

    return a.map_tiles(updated), (first, v, taus)


def band_to_tridiagonal(band: Band | TiledMatrix, width: int, group: int | None = None) -> Tridiagonal:
    """Bulge chasing by groups of sweeps; the diagonals come to the driver, reflectors are a dataset."""
    matrix = band.matrix if isinstance(band, Band) else band
    return Tridiagonal(*chase_bulges(matrix, width, group))


def tridiagonal_eigensolver(spark: SparkSession, d: np.ndarray, e: np.ndarray, nb: int = 64, dtype: str = "d", strategy: str | None = None, leaf: int | None = None) -> Eigen:
    """Divide and conquer: in one task for a small order, else merged level by level with the eigenvectors in tiles."""
    n = len(d)
    if not single_task(n, force=strategy):

        def both() -> tuple[DataFrame, TiledMatrix]:
            values, vectors = divide_and_conquer(spark, d, e, nb, leaf)
            return _values(spark, values), vectors.cast_to_complex() if dtype in "cz" else replace(vectors, dtype=dtype)

        return Eigen(both, lambda: _values(spark, eigenvalues(spark, d, e, nb, leaf)))
    w = TiledMatrix(spark.createDataFrame([], TILE), n, 1, nb, 1)
    z = TiledMatrix(w.tiles, n, n, nb, nb, dtype)
    sent = spark.sparkContext.broadcast((np.asarray(d, float), np.asarray(e, float)))

    def solve() -> list[np.ndarray]:
        values, vectors = S.tridiagonal_eigensolver(*sent.value)
        return [values[:, None], vectors]

    values, vectors = in_one_task(solve, [], [w, z])
    return Eigen(lambda: (_column(values), vectors))


def _by_column_blocks(e: TiledMatrix, f) -> TiledMatrix:
    """f of each block column, in the task that has it."""
    bare = replace(e, tiles=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles():
            now, whole = None, None
            for batch in batches:
                for ti, tj, x in unpack(batch):
                    if tj != now:
                        if now is not None:
                            yield from ((k, now, y) for k, y in _pieces(f(whole)))
                        now, whole = tj, np.zeros((m, x.shape[1]), kind)
                    whole[ti * bare.mb : ti * bare.mb + x.shape[0]] = x
            if now is not None:
                yield from ((k, now, y) for k, y in _pieces(f(whole)))

        def _pieces(y):
            return ((k // bare.mb, y[k : k + bare.mb]) for k in range(0, m, bare.mb))

        yield from packed(tiles(), bare.complex)

    m, kind = e.m, e.numpy_type
    return replace(e, tiles=e.tiles.repartition("tj").sortWithinPartitions("tj").mapInArrow(run, TILE))


def _parts(steps: list[tuple[int, np.ndarray, object]]) -> list[list]:
    """Reflectors or panels in runs that may be broadcast, each of BROADCAST_BYTES at most (or of one step)."""
    parts: list[list] = []
    held = 0
    for step in steps:
        if not parts or held + step[1].nbytes > BROADCAST_BYTES:
            parts.append([])
            held = 0
        parts[-1].append(step)
        held += step[1].nbytes
    return parts


def bt_band_to_tridiagonal(e: TiledMatrix, reflectors: Reflectors, group: int | None = None) -> TiledMatrix:
    """Q E for the reflectors of the bulge chasing, in blocks of ``group`` sweeps; columns of E are independent."""
    return apply_steps(e, blocks_of(reflectors, group), reflectors.complex).stored("back")


def bt_reduction_to_band(c: TiledMatrix, panels: list[tuple[int, np.ndarray, np.ndarray]] | DataFrame) -> TiledMatrix:
    """Q C for the panels of the band reduction: a list, or a dataset of steps."""
    if isinstance(panels, DataFrame):
        return apply_steps(c, panels, c.complex or panels.filter("im is not null").limit(1).count() > 0).stored("back")
    if panels and np.iscomplexobj(panels[0][1]) and not c.complex:
        c = c.cast_to_complex()
    for part in reversed(_parts(panels)):
        sent = c.spark.sparkContext.broadcast(part)
        c = _by_column_blocks(c, lambda x, sent=sent: S.apply_panels(sent.value, x)).stored("back")
    return c


def heevd(uplo: str, a: TiledMatrix, end: int | None = None, strategy: str | None = None, band: int | None = None) -> Eigen:
    """All eigenvalues, ascending, and the first ``end`` eigenvectors (all by default) of a Hermitian matrix."""
    require(a.m == a.n and a.mb == a.nb, "the matrix isn't square, or its tiles aren't")
    end = a.n if end is None else end
    require(0 <= end <= a.n, "the range of eigenvectors isn't inside the spectrum")
    if a.n == 0:
        return Eigen(lambda: (_values(a.spark, np.zeros(0)), a))
    if single_task(a.m, force=strategy):
        value = replace(a, n=1, nb=1, dtype="d" if a.dtype in "dz" else "s")
        vector = replace(a, n=end)

        def solve(x: np.ndarray) -> list[np.ndarray]:
            w, z = np.linalg.eigh(K.full(x, uplo))
            return [w[:, None], z[:, :end]]

        values, vectors = in_one_task(solve, [a], [value, vector])
        return Eigen(lambda: (_column(values), vectors))
    width = band or band_size(a.nb)
    banded = reduction_to_band(a.hermitian(uplo), width)
    tri = band_to_tridiagonal(banded, width)
    middle = tridiagonal_eigensolver(a.spark, tri.d, tri.e, a.nb, a.dtype, "tiles")

    def both() -> tuple[DataFrame, TiledMatrix]:
        values, z = middle
        z = z.submatrix(0, 0, a.n, end) if end < a.n else z
        return values, bt_reduction_to_band(bt_band_to_tridiagonal(z, tri.reflectors), banded.panels)

    return Eigen(both, lambda: middle.values)


def hegvd(uplo: str, a: TiledMatrix, b: TiledMatrix, factorized: bool = False, end: int | None = None, strategy: str | None = None) -> Eigen:
    """A x = lambda B x with Eᴴ B E = 1; B is positive definite, or its factor if ``factorized``."""
    factor = b.triangle(uplo) if factorized else potrf(uplo, b, strategy).stored("factor")
    standard = hegst(uplo, a, factor, strategy).stored("standard")
    inner = heevd(uplo, standard, end, strategy)

    def both() -> tuple[DataFrame, TiledMatrix]:
        values, vectors = inner
        return values, vectors if vectors.n == 0 else trsm("L", uplo, "C" if uplo == "L" else "N", "N", factor, vectors, 1, strategy)

    return Eigen(both, lambda: inner.values)
