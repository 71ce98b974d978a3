"""General, Hermitian and triangular multiplication: operands meet by blocks of rows, columns and inner tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, packed, summed, unpack
from ..plans.strategy import chain_order

#: Numbers of a block of A, and of a block of the result, that a task holds.
HELD = 4 << 20


def _common(*matrices: TiledMatrix | None) -> str:
    kinds = {a.dtype for a in matrices if a is not None}
    wide, complex_ = bool(kinds & {"d", "z"}), bool(kinds & {"c", "z"})
    return ("z" if wide else "c") if complex_ else ("d" if wide else "s")


#: Places of tiles that are wanted, for whole blocks of tiles: (first i, last i, first j, last j).
_BLOCKS = {"true": lambda i0, i1, j0, j1: True, "i >= j": lambda i0, i1, j0, j1: i1 >= j0, "i <= j": lambda i0, i1, j0, j1: i0 <= j1}


def grid(tiles: tuple[int, int, int], sizes: tuple[int, int, int], tasks: int) -> tuple[int, int, int]:
    """Blocks of rows, columns and inner tiles: at least ``tasks`` if there are so many products, with as little as can be moved.

    A's block and the result's block stay below ``HELD`` numbers, unless they are single tiles. A moves to each block of
    columns, B to each block of rows, and sums move if the inner size is cut.
    """
    (mt, nt, kt), (mb, nb, kb) = tiles, sizes
    options = lambda t: sorted({*(2**x for x in range(t.bit_length()) if 2**x <= t), t})
    best = None
    for i in options(mt):
        for j in options(nt):
            if -(-mt // i) * -(-nt // j) * mb * nb > HELD and (i, j) != (mt, nt):
                continue
            for k in options(kt):
                if -(-mt // i) * -(-kt // k) * mb * kb > HELD and (i, k) != (mt, kt):
                    continue
                few = max(0, min(tasks, mt * nt * kt) - i * j * k)
                moved = mt * kt * mb * kb * j + nt * kt * nb * kb * i + (mt * nt * mb * nb * k if k > 1 else 0)
                if best is None or (few, moved, i * j * k) < best[0]:
                    best = (few, moved, i * j * k), (i, j, k)
    return best[1]


def _products(a: TiledMatrix, b: TiledMatrix, alpha: complex, complex_: bool, where: str = "true") -> tuple[DataFrame, bool]:
    """Products by place, and whether each place is there once: operands meet by blocks of rows, columns and inner tiles.

    A tile of A goes to every wanted block of columns, one of B to every block of rows; in a task B's tiles
    pass by A's block, and sums leave it once for each place.
    """
    spark = a.spark
    tiles = (max(1, a.rows.tiles), max(1, b.columns.tiles), max(1, a.columns.tiles))
    blocks = grid(tiles, (min(a.mb, a.m), min(b.nb, b.n), min(a.nb, a.n)), 2 * spark.sparkContext.defaultParallelism)
    bi, bj, bk = (-(-t // n) for t, n in zip(tiles, blocks, strict=True))
    wanted = [(i, j) for i in range(-(-tiles[0] // bi)) for j in range(-(-tiles[1] // bj)) if _BLOCKS[where](i * bi, min(tiles[0], i * bi + bi) - 1, j * bj, min(tiles[1], j * bj + bj) - 1)]
    inner = -(-tiles[2] // bk)
    # One row for each block of the result.
    pairs = F.broadcast(spark.createDataFrame(wanted, "gi long, gj long"))
    key = ["gi", "gj", "gk"]
    left = a.tiles.withColumns({"gi": F.expr(f"ti div {bi}"), "gk": F.expr(f"tj div {bk}"), "side": F.lit(0)}).join(pairs, "gi")
    right = b.tiles.withColumns({"gj": F.expr(f"tj div {bj}"), "gk": F.expr(f"ti div {bk}"), "side": F.lit(1)}).join(pairs, "gj")
    both = left.unionByName(right).select(*a.tiles.columns, "side", *key)
    wants = _BLOCKS[where]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[Tile]:
            now, held, sums = None, {}, {}
            for batch in batches:
                keys = zip(*(batch.column(c).to_pylist() for c in (6, 7, 8, 9)), strict=True)
                for (ti, tj, x), (side, *block) in zip(unpack(batch), keys, strict=True):
                    if block != now:
                        yield from ((*place, alpha * c) for place, c in sums.items())
                        now, held, sums = block, {}, {}
                    if side == 0:
                        held.setdefault(tj, []).append((ti, x))
                        continue
                    for i, y in held.get(ti, ()):
                        if wants(i, i, tj, tj):
                            product = y @ x
                            sums[i, tj] = sums[i, tj] + product if (i, tj) in sums else product
            yield from ((*place, alpha * c) for place, c in sums.items())

        yield from packed(out(), complex_)

    parts = max(1, min(len(wanted) * inner, 16 * spark.sparkContext.defaultParallelism))
    return both.repartition(parts, *key).sortWithinPartitions(*key, "side").mapInArrow(run, TILE), inner == 1


def gemm(a: TiledMatrix, b: TiledMatrix, alpha: complex = 1, beta: complex = 0, c: TiledMatrix | None = None, opa: str = "N", opb: str = "N", where: str = "true") -> TiledMatrix:
    """alpha op(A) op(B) + beta C; with an inner size of 0 only beta C. where: the places of tiles that are wanted, a key of ``_BLOCKS``."""
    a, b = a.op(opa), b.op(opb)
    require(a.n == b.m and a.nb == b.mb, "A's columns and B's rows differ in size or tiles")
    require(c is None or (c.m, c.n, c.mb, c.nb) == (a.m, b.n, a.mb, b.nb), "C has another shape or other tiles")
    dtype = _common(a, b, c)
    if dtype in "cz":
        a, b, c = (x if x is None or x.complex else x.cast_to_complex() for x in (a, b, c))
    out = replace(a, n=b.n, nb=b.nb, dtype=dtype)
    keep = c.scale(beta) if c is not None and beta != 0 else None
    if 0 in (a.m, a.n, b.n) or alpha == 0:
        return keep or replace(out, tiles=a.tiles.limit(0))
    products, once = _products(a, b, alpha, out.complex, where)
    if once and keep is None:
        return replace(out, tiles=products)
    return replace(out, tiles=summed(products if keep is None else products.unionAll(keep.tiles), out.complex))


def chain(*matrices: TiledMatrix) -> TiledMatrix:
    """A product of matrices in the order that takes the fewest operations."""

    def build(node: int | list) -> TiledMatrix:
        return matrices[node] if isinstance(node, int) else gemm(build(node[0]), build(node[1]))

    return build(chain_order([matrices[0].m, *(x.n for x in matrices)])[1])


def hemm(side: str, uplo: str, a: TiledMatrix, b: TiledMatrix, alpha: complex = 1, beta: complex = 0, c: TiledMatrix | None = None) -> TiledMatrix:
    """alpha A B + beta C or alpha B A + beta C for a Hermitian A given by a triangle."""
    h = a.hermitian(uplo)
    return gemm(h, b, alpha, beta, c) if side == "L" else gemm(b, h, alpha, beta, c)


def trmm(side: str, uplo: str, op: str, diag: str, a: TiledMatrix, b: TiledMatrix, alpha: complex = 1) -> TiledMatrix:
    """alpha op(A) B or alpha B op(A) for a triangular A."""
    require(a.m == a.n, "A isn't square")
    t = a.triangle(uplo, diag)
    if diag == "U":  # tiles of zeros may be missing, their unit diagonal isn't
        t = _with_diagonal(t)
    t = t.op(op)
    return gemm(t, b, alpha) if side == "L" else gemm(b, t, alpha)


def _with_diagonal(t: TiledMatrix) -> TiledMatrix:
    eye = TiledMatrix.generate(t.spark, t.m, t.n, t.mb, t.nb, lambda i, j: (i == j) * 1.0, t.dtype, keep="ti = tj")
    missing = eye.tiles.join(t.tiles.select("ti", "tj"), ["ti", "tj"], "left_anti").select(*t.tiles.columns)
    return replace(t, tiles=t.tiles.unionAll(missing))


#: Places of a triangle's tiles: only these are multiplied.
_INSIDE = {"L": "i >= j", "U": "i <= j"}


def herk(uplo: str, a: TiledMatrix, alpha: float = 1, beta: float = 0, c: TiledMatrix | None = None, op: str = "N") -> TiledMatrix:
    """The triangle of alpha A Aᴴ + beta C, or of alpha Aᴴ A + beta C."""
    x = a if op == "N" else a.transpose(conjugate=True)
    return gemm(x, x.transpose(conjugate=True), alpha, beta, c, where=_INSIDE[uplo]).triangle(uplo)


def her2k(uplo: str, a: TiledMatrix, b: TiledMatrix, alpha: complex = 1, beta: float = 0, c: TiledMatrix | None = None) -> TiledMatrix:
    """The triangle of alpha A Bᴴ + conj(alpha) B Aᴴ + beta C."""
    first = gemm(a, b.transpose(conjugate=True), alpha, beta, c, where=_INSIDE[uplo])
    return gemm(b, a.transpose(conjugate=True), np.conj(alpha), 1, first, where=_INSIDE[uplo]).triangle(uplo)


def lauum(uplo: str, a: TiledMatrix) -> TiledMatrix:
    """The triangle of Lᴴ L (lower) or U Uᴴ (upper)."""
    t = a.triangle(uplo)
    h = t.transpose(conjugate=True)
    return (gemm(h, t, where=_INSIDE[uplo]) if uplo == "L" else gemm(t, h, where=_INSIDE[uplo])).triangle(uplo)


def add(a: TiledMatrix, b: TiledMatrix, alpha: complex = 1) -> TiledMatrix:
    """A + alpha B."""
    require((a.m, a.n, a.mb, a.nb) == (b.m, b.n, b.mb, b.nb), "shapes or tiles differ")
    return replace(a, tiles=summed(a.tiles.unionAll(b.scale(alpha).tiles), a.complex))


def scale_columns(a: TiledMatrix, factors: DataFrame) -> TiledMatrix:
    """A diag(w) for a table (idx, value); the factors of a tile's columns travel with it."""
    w = factors.select(F.expr(f"idx div {a.nb}").alias("tj"), F.struct(F.expr(f"idx % {a.nb}").alias("at"), "value").alias("f"))
    w = w.groupBy("tj").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["value"]).alias("w"))
    scaled = lambda c: F.expr(f"transform({c}, (x, k) -> x * w[cast(k div nr as int)])")
    tiles = a.tiles.join(w, "tj").withColumn("re", scaled("re")).withColumn("im", F.when(F.col("im").isNotNull(), scaled("im"))).select(*a.tiles.columns)
    return replace(a, tiles=tiles)


__all__ = ["gemm", "chain", "hemm", "trmm", "herk", "her2k", "lauum", "add", "scale_columns", "K"]
