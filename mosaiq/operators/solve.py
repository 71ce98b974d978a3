"""Triangular solves and what follows from them: inverses and the reduction to a standard eigenproblem."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, in_one_task, packed, unpack
from ..plans.strategy import fits_broadcast, single_task
from .multiply import _common, add, gemm, lauum


def trsm(side: str, uplo: str, op: str, diag: str, a: TiledMatrix, b: TiledMatrix, alpha: complex = 1, strategy: str | None = None) -> TiledMatrix:
    """X of op(A) X = alpha B or X op(A) = alpha B; zeros for alpha = 0.

    One task for small matrices. Otherwise the columns (rows) of B are independent: A is sent to all tasks while
    it fits the broadcast bound, and each task solves for the block columns it has; a larger A is gone through
    by block rows, each step a product with the panel just solved.
    """
    require(a.m == a.n and a.mb == a.nb, "A isn't square, or its tiles aren't")
    require((b.m, b.mb) == (a.m, a.mb) if side == "L" else (b.n, b.nb) == (a.m, a.mb), "B's size or tiles don't fit A's")
    dtype = _common(a, b)
    if dtype in "cz":
        a, b = (x if x.complex else x.cast_to_complex() for x in (a, b))
    b = replace(b, dtype=dtype)
    if alpha == 0 or b.m == 0 or b.n == 0:
        return replace(b, tiles=b.tiles.limit(0))
    if single_task(a.m, b.m, b.n, force=strategy):
        return in_one_task(lambda x, y: [K.trsm(side, uplo, op, diag, x, y, alpha)], [a, b], [b])[0]
    if fits_broadcast(a.m, a.n, dtype) and strategy is None or strategy == "tiles" and fits_broadcast(a.m, a.n, dtype):
        return _by_columns(side, uplo, op, diag, a, b, alpha)
    return _by_steps(side, uplo, op, diag, a, b, alpha)


def _by_columns(side, uplo, op, diag, a: TiledMatrix, b: TiledMatrix, alpha) -> TiledMatrix:
    sent = a.spark.sparkContext.broadcast(a.triangle(uplo).to_numpy())
    key = "tj" if side == "L" else "ti"
    bare = replace(b, tiles=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(k: int, tiles: list[Tile]) -> Iterator[Tile]:
            whole = np.zeros((b_m, tiles[0][2].shape[1]) if side == "L" else (tiles[0][2].shape[0], b_n), bare.numpy_type)
            for ti, tj, x in tiles:
                at = ti * bare.mb if side == "L" else tj * bare.nb
                if side == "L":
                    whole[at : at + x.shape[0]] = x
                else:
                    whole[:, at : at + x.shape[1]] = x
            out = K.trsm(side, uplo, op, diag, sent.value, whole, alpha)
            step = bare.mb if side == "L" else bare.nb
            for t in range(-(-(b_m if side == "L" else b_n) // step)):
                cut = slice(t * step, (t + 1) * step)
                yield (t, k, out[cut]) if side == "L" else (k, t, out[:, cut])

        def tiles() -> Iterator[Tile]:
            now, held = None, []
            for batch in batches:
                for tile in unpack(batch):
                    k = tile[1] if side == "L" else tile[0]
                    if k != now and held:
                        yield from solved(now, held)
                        held = []
                    now = k
                    held.append(tile)
            if held:
                yield from solved(now, held)

        yield from packed(tiles(), bare.complex)

    b_m, b_n = b.m, b.n
    return replace(b, tiles=b.tiles.repartition(key).sortWithinPartitions(key).mapInArrow(run, TILE))


def _by_steps(side, uplo, op, diag, a: TiledMatrix, b: TiledMatrix, alpha) -> TiledMatrix:
    if side == "R":  # X op(A) = alpha B is op(A)ᵀ Xᵀ = alpha Bᵀ
        if op == "C":
            a, op = a.map_tiles(lambda ti, tj, x: x.conj()), "T"
        turned = {"N": "T", "T": "N"}[op]
        return _by_steps("L", uplo, turned, diag, a, b.transpose(), alpha).transpose()
    t = a.triangle(uplo, diag).op(op).stored("triangle")
    lower = (uplo == "L") == (op == "N")
    order = range(t.rows.tiles) if lower else range(t.rows.tiles - 1, -1, -1)
    rest, done = b.scale(alpha).stored("right"), None
    for k in order:
        at, size = k * t.mb, min(t.mb, t.m - k * t.mb)
        corner = t.submatrix(at, at, size, size).to_numpy()
        solve = lambda ti, tj, x, corner=corner: K.trsm("L", "L" if lower else "U", "N", "N", corner, x)
        panel = rest.map_tiles(solve, keep=f"ti = {k}").stored("panel")
        done = panel if done is None else replace(panel, tiles=done.tiles.unionAll(panel.tiles))
        left = replace(t, tiles=t.tiles.filter(f"tj = {k} and ti {'>' if lower else '<'} {k}"))
        rest = replace(rest, tiles=rest.tiles.filter(f"ti {'>' if lower else '<'} {k}"))
        rest = add(rest, gemm(left, panel), -1).stored("right")
    return done if done is not None else b


def identity(like: TiledMatrix) -> TiledMatrix:
    return TiledMatrix.generate(like.spark, like.m, like.m, like.mb, like.nb, lambda i, j: (i == j) * 1.0, like.dtype, keep="ti = tj")


def trtri(uplo: str, diag: str, a: TiledMatrix, strategy: str | None = None) -> TiledMatrix:
    """The inverse of a triangular matrix, in its triangle (a unit diagonal isn't stored)."""
    require(a.m == a.n and a.mb == a.nb, "the matrix isn't square, or its tiles aren't")
    if single_task(a.m, force=strategy):
        return in_one_task(lambda x: [K.triangle(K.trtri(uplo, diag, x), uplo)], [a], [a])[0]
    return trsm("L", uplo, "N", diag, a, identity(a), 1, "tiles").triangle(uplo)


def potri(uplo: str, a: TiledMatrix, strategy: str | None = None) -> TiledMatrix:
    """The triangle of the inverse of L Lᴴ (Uᴴ U), from the factor."""
    return lauum(uplo, trtri(uplo, "N", a, strategy))


def hegst(uplo: str, a: TiledMatrix, factor: TiledMatrix, strategy: str | None = None) -> TiledMatrix:
    """The triangle of inv(L) A inv(Lᴴ) or inv(Uᴴ) A inv(U)."""
    left = trsm("L", uplo, "N" if uplo == "L" else "C", "N", factor, a.hermitian(uplo), 1, strategy)
    return trsm("R", uplo, "C" if uplo == "L" else "N", "N", factor, left, 1, strategy).triangle(uplo)


__all__ = ["trsm", "trtri", "potri", "hegst", "identity", "F"]
