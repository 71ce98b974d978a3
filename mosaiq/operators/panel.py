"""QR of tall panels by a tree of tasks, as one block reflector.

A panel is a table of strips (ti, tile), ti being the first row. Each strip is factored in its task; their triangular factors are
stacked and factored again in groups of ``FAN``, level by level, and the small orthogonal factors go back down. From the first rows of the
orthogonal factor the driver makes what turns it into reflectors (Householder vectors from an orthogonal factor: an
elimination without pivots whose signs keep each pivot at 1 or more). Only such band x band matrices come to the driver; vectors are a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, pack, packed, unpack
from ..plans.strategy import Scratch

#: Triangular factors that a task of the tree stacks.
FAN = 16

#: Kinds of rows, in tj: orthogonal factor of a strip or of a node's child, triangular factor.
ORTHOGONAL, TRIANGULAR = 0, 1


def reconstruct(top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, U and signs s with 1 - Q S = L U for the first rows Q of an orthogonal factor; the reflectors are L, and below -Q S U⁻¹."""
    b = len(top)
    q, e = top.copy(), np.eye(b, dtype=top.dtype)
    low, signs = np.eye(b, dtype=top.dtype), np.ones(b, top.dtype)
    for j in range(b):
        w = q[j, j]
        signs[j] = -np.conj(w) / abs(w) if w != 0 else 1
        column = e[:, j] - signs[j] * q[:, j]
        low[j + 1 :, j] = column[j + 1 :] / column[j]
        q[j + 1 :] -= np.outer(low[j + 1 :, j], q[j])
        e[j + 1 :] -= np.outer(low[j + 1 :, j], e[j])
    return low, np.triu(e - q * signs), signs


def _factored(tiles: DataFrame, complex_: bool) -> DataFrame:
    """Of each strip (ti): its orthogonal and its triangular factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Tile]:
            for batch in batches:
                for ti, _, x in unpack(batch):
                    q, r = np.linalg.qr(x)
                    yield ti, ORTHOGONAL, q
                    yield ti, TRIANGULAR, r

        yield from packed(out(), complex_)

    return tiles.mapInArrow(run, TILE)


def _stacked(factors: DataFrame, complex_: bool) -> DataFrame:
    """Triangular factors of a node's children stacked and factored; the pieces of the orthogonal factor are the children's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(node: int, children: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            q, r = np.linalg.qr(np.concatenate([x for _, x in children]))
            cuts = np.cumsum([len(x) for _, x in children])[:-1]
            pieces = [(child, ORTHOGONAL, piece) for (child, _), piece in zip(children, np.split(q, cuts), strict=True)]
            return pack([*pieces, (node, TRIANGULAR, r)], complex_)

        now, held = None, []
        for batch in batches:
            for (child, _, x), node in zip(unpack(batch), batch.column(6).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        yield out(now, held)
                    now, held = node, []
                held.append((child, x))
        if now is not None:
            yield out(now, held)

    return factors.repartition("node").sortWithinPartitions("node", "ti").mapInArrow(run, TILE)


def _times(left: DataFrame, right: DataFrame, complex_: bool) -> DataFrame:
    """Products of the orthogonal factors of (ti) with the piece that the tree gives to their node."""
    named = right.select(F.col("ti").alias("node"), *(F.col(c).alias(f"r_{c}") for c in ("nr", "nc", "re", "im")))
    pairs = left.join(named, "node").selectExpr("ti", "tj", "nr", "nc", "re", "im", "ti a", "tj b", "r_nr", "r_nc", "r_re", "r_im")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((ti, tj, x @ y) for batch in batches for (ti, tj, x), (_, _, y) in zip(unpack(batch), unpack(batch, 6), strict=True)), complex_)

    return pairs.mapInArrow(run, TILE)


def tall_qr(scratch: Scratch, strips: DataFrame, count: int, complex_: bool) -> tuple[DataFrame, np.ndarray]:
    """The orthogonal factor's strips, and the triangular factor; strips are numbered in ti from 0 to count - 1, from the top."""
    level = scratch.stored(_factored(strips, complex_))
    levels, factors = [level.filter(f"tj = {ORTHOGONAL}")], level.filter(f"tj = {TRIANGULAR}")
    while count > 1:
        count = -(-count // FAN)
        level = scratch.stored(_stacked(factors.withColumn("node", F.expr(f"ti div {FAN}")), complex_))
        levels.append(level.filter(f"tj = {ORTHOGONAL}"))
        factors = level.filter(f"tj = {TRIANGULAR}")
    r = next(x for batch in factors.toArrow().to_batches() for _, _, x in unpack(batch))
    q = levels.pop()
    while levels:  # from the root down: each factor times the piece that its node got
        own = levels.pop()
        q = _times(own.withColumn("node", F.expr(f"ti div {FAN}" if levels else "ti")), q, complex_)
    return q, r


def block_reflector(scratch: Scratch, strips: DataFrame, count: int, band: int, complex_: bool) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """V's strips, T and R' of a panel with ``band`` columns: (1 - V T Vᴴ)ᴴ panel is R' above zeros. Strip 0 has ``band`` rows or more."""
    q, r = tall_qr(scratch, strips, count, complex_)
    q = scratch.stored(q)

    def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((ti, tj, x[:band]) for batch in batches for ti, tj, x in unpack(batch)), complex_)

    top = next(x for batch in q.filter("ti = 0").mapInArrow(first_rows, TILE).toArrow().to_batches() for _, _, x in unpack(batch))
    low, upper, signs = reconstruct(top)
    turn = -signs[:, None] * np.linalg.inv(upper)
    # Three band x band matrices.
    sent = q.sparkSession.sparkContext.broadcast((low, turn))

    def reflectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Tile]:
            low, turn = sent.value
            for batch in batches:
                for ti, _, x in unpack(batch):
                    yield ti, 0, np.concatenate((low, x[band:] @ turn)) if ti == 0 else x @ turn

        yield from packed(out(), complex_)

    return scratch.stored(q.mapInArrow(reflectors, TILE)), upper @ np.linalg.inv(low).conj().T, np.conj(signs)[:, None] * r


def tall_skinny_qr(a: TiledMatrix) -> tuple[TiledMatrix, np.ndarray, np.ndarray]:
    """V, T and R of a matrix of one tile column: (1 - V T Vᴴ) (R, then zeros) is A. Its first tile isn't wider than tall."""
    require(a.columns.tiles == 1 and min(a.mb, a.m) >= a.n, "a tall matrix with one column of tiles is needed")
    zeros = TiledMatrix.generate(a.spark, a.m, a.n, a.mb, a.nb, lambda i, j: np.zeros((i.size, j.size)), a.dtype)
    filled = a.tiles.unionAll(zeros.tiles.join(a.tiles.select("ti"), "ti", "left_anti").select(*a.tiles.columns))
    with Scratch(a.spark) as scratch:
        v, t, r = block_reflector(scratch, filled, a.rows.tiles, a.n, a.complex)
        return replace(a, tiles=v).stored("reflectors"), t, r
