"""Cholesky factorization."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, in_one_task, packed, unpack
from ..plans.strategy import Scratch, shared_dir, single_task, written

NotPositiveDefinite = K.NotPositiveDefinite


def potrf(uplo: str, a: TiledMatrix, strategy: str | None = None) -> TiledMatrix:
    """A = L Lᴴ or A = Uᴴ U; only A's triangle is read, and only the factor's is returned.

    Right-looking by block columns: the diagonal tile is factored on the driver (one tile), its column is solved
    in place, and each trailing tile meets its two panel tiles in joins on the tile indices.
    """
    require(a.m == a.n and a.mb == a.nb, "the matrix isn't square, or its tiles aren't")
    if a.m == 0:
        return a
    if single_task(a.m, force=strategy):
        return in_one_task(lambda x: [K.triangle(K.potrf(uplo, x), uplo)], [a], [a])[0]
    if uplo == "U":
        return potrf("L", a.transpose(conjugate=True), strategy).transpose(conjugate=True)
    folder = f"{shared_dir(a.spark)}/factor-{uuid.uuid4().hex}"
    place = lambda k: f"{folder}/{k:06d}"
    with Scratch(a.spark) as scratch:
        rest = replace(a, tiles=scratch.stored(a.tiles.filter("ti >= tj")))
        for k in range(a.rows.tiles):
            at, size = k * a.mb, min(a.mb, a.m - k * a.mb)
            corner, info = K.potrf_info("L", rest.submatrix(at, at, size, size).to_numpy())
            if info:
                raise NotPositiveDefinite(at + info)
            lower = K.triangle(corner, "L")
            column = lambda ti, tj, x, lower=lower: lower if ti == tj else K.trsm("R", "L", "C", "N", lower, x)
            written(rest.map_tiles(column, keep=f"tj = {k}").tiles, place(k))
            panel = replace(a, tiles=a.spark.read.schema(TILE).parquet(place(k)))
            if k + 1 < a.rows.tiles:
                rest = replace(rest, tiles=scratch.stored(_updated(rest, panel, k).tiles))
                scratch.drop_before()
    return replace(a, tiles=a.spark.read.schema(TILE).parquet(*map(place, range(a.rows.tiles))))


def _updated(rest: TiledMatrix, panel: TiledMatrix, k: int) -> TiledMatrix:
    """Trailing tiles (i, j) less L_ik L_jkᴴ: each meets its two panel tiles in equi-joins on i, then on j.

    A missing tile is zero. Places where the panel makes a tile that isn't there yet come from tile indices alone.
    """
    below = panel.tiles.filter(f"ti > {k}")
    trailing = rest.tiles.filter(f"tj > {k}")
    index = below.select("ti", "nr")
    places = index.select("ti", "nr", F.explode(F.sequence(F.lit(k + 1).cast("long"), "ti")).alias("tj")).join(index.select(F.col("ti").alias("tj"), F.col("nr").alias("nc")), "tj")
    fresh = places.join(trailing.select("ti", "tj"), ["ti", "tj"], "left_anti").selectExpr("ti", "tj", "nr", "nc", "cast(null as array<double>) re", "cast(null as array<double>) im")
    trailing = trailing.unionAll(fresh)
    rows = below.select("ti", *(F.col(c).alias(f"a_{c}") for c in ("re", "im")))
    columns = below.select(F.col("ti").alias("tj"), *(F.col(c).alias(f"b_{c}") for c in ("re", "im")))
    pairs = trailing.join(rows, "ti", "left").join(columns, "tj", "left")
    width, complex_ = min(panel.mb, panel.n - k * panel.nb), rest.complex

    named = pairs.withColumnsRenamed({"re": "c_re", "im": "c_im"}).selectExpr("*", f"{width} w")
    tile = []
    for v, r, c, i, j in (("a", "nr", "w", "ti", "0L"), ("b", "nc", "w", "tj", "0L"), ("c", "nr", "nc", "ti", "tj")):
        zeros = f"transform(sequence(1, {r} * {c}), x -> 0D)"
        imaginary = f"coalesce({v}_im, {zeros})" if complex_ else "cast(null as array<double>)"
        tile += [f"{i} {v}_i", f"{j} {v}_j", f"{r} {v}_r", f"{c} {v}_c", f"coalesce({v}_re, {zeros}) {v}_re", f"{imaginary} {v}_im"]
    both = named.selectExpr(*tile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            for batch in batches:
                for (_, _, x), (_, _, y), (i, j, c) in zip(unpack(batch), unpack(batch, 6), unpack(batch, 12), strict=True):
                    yield i, j, c - x @ y.conj().T

        yield from packed(tiles(), complex_)

    return replace(rest, tiles=both.mapInArrow(run, TILE))
