"""A matrix as a DataFrame of column-major tiles.

Tiles are rows (ti, tj, nr, nc, re, im); im is null in a real matrix. A tile that isn't there is zero. Matrices
don't change: an operation gives a new one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Axis, require
from .plans.strategy import stored

TILE = "ti long, tj long, nr int, nc int, re array<double>, im array<double>"
ARROW = pa.schema([("ti", pa.int64()), ("tj", pa.int64()), ("nr", pa.int32()), ("nc", pa.int32()), ("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])
#: Values that a task holds before it hands tiles on.
FLUSH = 1 << 20

Tile = tuple[int, int, np.ndarray]


def unpack(batch: pa.RecordBatch, at: int = 0) -> Iterator[Tile]:
    """The tiles of a batch whose columns start at ``at``."""
    ti, tj, nr, nc = (batch.column(at + k).to_pylist() for k in range(4))
    re, im = batch.column(at + 4), batch.column(at + 5)
    for k in range(batch.num_rows):
        values = re[k].values.to_numpy(zero_copy_only=False)
        if im[k].is_valid:
            values = values + 1j * im[k].values.to_numpy(zero_copy_only=False)
        yield ti[k], tj[k], values.reshape((nr[k], nc[k]), order="F")


def pack(tiles: Iterable[Tile], complex_: bool, extra: dict[str, pa.Array] | None = None) -> pa.RecordBatch:
    tiles = list(tiles)
    flat = [np.asarray(a).ravel(order="F") for _, _, a in tiles]
    lists = lambda x: pa.array([None if v is None else v for v in x], pa.list_(pa.float64()))
    columns = [
        pa.array([t[0] for t in tiles], pa.int64()),
        pa.array([t[1] for t in tiles], pa.int64()),
        pa.array([t[2].shape[0] for t in tiles], pa.int32()),
        pa.array([t[2].shape[1] for t in tiles], pa.int32()),
        lists([np.ascontiguousarray(v.real, dtype=np.float64) for v in flat]),
        lists([np.ascontiguousarray(v.imag, dtype=np.float64) if complex_ else None for v in flat]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def packed(tiles: Iterable[Tile], complex_: bool) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    held, size = [], 0
    for tile in tiles:
        held.append(tile)
        size += tile[2].size
        if size >= FLUSH:
            yield pack(held, complex_)
            held, size = [], 0
    if held:
        yield pack(held, complex_)


@dataclass(frozen=True)
class Source:
    """How a generated matrix's tiles are made: a table of places and the tile of a place, which may stand for its mirror, too."""

    tiles: DataFrame
    places: DataFrame
    make: Callable[[int, int], np.ndarray]
    hermitian: bool = False


def _mirrored(places: DataFrame, keep: str) -> DataFrame:
    """Places of a triangle, with whether ``keep`` holds for a place (own) and for its mirror (other), and did before."""
    if "own" not in places.columns:
        places = places.selectExpr("ti", "tj", "true own", "ti != tj other")
    turned = places.withColumn("own", F.col("own") & F.expr(keep)).selectExpr("tj ti", "ti tj", "own", "other")
    return turned.withColumn("other", F.col("other") & F.expr(keep)).selectExpr("tj ti", "ti tj", "own", "other").filter("own or other")


def _made(make: Callable[[int, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[Tile]]:
    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[Tile]:
        for batch in batches:
            for ti, tj, *sides in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = make(ti, tj)
                if not sides or sides[0]:
                    yield ti, tj, x
                if sides and sides[1]:
                    yield tj, ti, x.conj().T

    return tiles


@dataclass(frozen=True)
class TiledMatrix:
    tiles: DataFrame
    m: int
    n: int
    mb: int
    nb: int
    dtype: str = "d"
    source: Source | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "source": None}

    def __post_init__(self) -> None:
        require(self.dtype in ("s", "d", "c", "z"), "dtype is one of s, d, c, z")
        require(self.m >= 0 and self.n >= 0 and self.mb > 0 and self.nb > 0, "sizes can't be negative, tiles can't be empty")

    @property
    def complex(self) -> bool:
        return self.dtype in "cz"

    @property
    def rows(self) -> Axis:
        return Axis(self.m, self.mb)

    @property
    def columns(self) -> Axis:
        return Axis(self.n, self.nb)

    @property
    def spark(self) -> SparkSession:
        return self.tiles.sparkSession

    @property
    def numpy_type(self) -> np.dtype:
        return np.dtype({"s": np.float32, "d": np.float64, "c": np.complex64, "z": np.complex128}[self.dtype])

    # -- making and reading --------------------------------------------------------------

    @classmethod
    def from_numpy(cls, spark: SparkSession, a: np.ndarray, mb: int, nb: int) -> TiledMatrix:
        a = np.asarray(a)
        dtype = {"float32": "s", "complex64": "c", "complex128": "z"}.get(a.dtype.name, "d")
        out = cls(spark.createDataFrame([], TILE), *a.shape, mb, nb, dtype)
        tiles = list(out.split(a))
        if not tiles:
            return out
        return replace(out, tiles=spark.createDataFrame(pa.Table.from_batches([pack(tiles, out.complex)]), TILE))

    @classmethod
    def from_column_major(cls, spark: SparkSession, flat: np.ndarray, m: int, n: int, mb: int, nb: int, ld: int | None = None) -> TiledMatrix:
        """From the elements of a column-major array on the driver whose columns begin ``ld`` elements apart."""
        ld = max(m, 1) if ld is None else ld
        require(ld >= max(m, 1) and flat.ndim == 1 and (n == 0 or len(flat) >= (n - 1) * ld + m), "the array is shorter than its extents say, or its columns overlap")
        return cls.from_numpy(spark, np.lib.stride_tricks.as_strided(flat, (m, n), (flat.itemsize, ld * flat.itemsize)), mb, nb)

    def split(self, a: np.ndarray) -> Iterator[Tile]:
        """A dense array as tiles of this matrix's layout."""
        for i in range(0, self.m, self.mb):
            for j in range(0, self.n, self.nb):
                yield i // self.mb, j // self.nb, a[i : i + self.mb, j : j + self.nb]

    def to_numpy(self) -> np.ndarray:
        """The dense array, on the driver: for small matrices and tests."""
        return self.dense(unpack(b) for b in self.tiles.toArrow().to_batches())

    def dense(self, batches: Iterable[Iterable[Tile]]) -> np.ndarray:
        out = np.zeros((self.m, self.n), self.numpy_type)
        for tiles in batches:
            for ti, tj, a in tiles:
                out[ti * self.mb : ti * self.mb + a.shape[0], tj * self.nb : tj * self.nb + a.shape[1]] = a if self.complex else a.real
        return out

    @classmethod
    def generate(cls, spark: SparkSession, m: int, n: int, mb: int, nb: int, f: Callable, dtype: str = "d", keep: str = "true", hermitian: bool = False) -> TiledMatrix:
        """Elements f(i, j) of index arrays, a tile at a time; ``keep`` is SQL on ti and tj that selects tiles.

        Of a Hermitian matrix only the lower triangle's tiles are made, each gives its mirror.
        """
        out = cls(spark.createDataFrame([], TILE), m, n, mb, nb, dtype)
        across, total = out.columns.tiles, out.rows.tiles * out.columns.tiles
        if not total:
            return out
        if hermitian:
            require(m == n and mb == nb, "a Hermitian matrix is square, with square tiles")
            # Each row of tiles with as many tiles left of its diagonal, around the edge: tasks get the same work.
            half = across // 2 + 1
            ids = spark.range(0, across * half, 1, max(1, min(4 * spark.sparkContext.defaultParallelism, across * half // 64)))
            ids = ids.filter(f"id % {half} < {half - 1 + across % 2} or id div {half} < {across // 2}")
            places = ids.select(F.expr(f"id div {half}").alias("a"), F.expr(f"(id div {half} - id % {half} + {across}) % {across}").alias("b"))
            grid = places.select(F.greatest("a", "b").alias("ti"), F.least("a", "b").alias("tj"))
        else:
            grid = spark.range(total).select(F.expr(f"id div {across}").alias("ti"), F.expr(f"id % {across}").alias("tj"))

        def make(ti: int, tj: int) -> np.ndarray:
            i, j = np.arange(ti * mb, min(m, ti * mb + mb))[:, None], np.arange(tj * nb, min(n, tj * nb + nb))[None, :]
            return np.broadcast_to(np.asarray(f(i, j)), (i.size, j.size))

        made = _made(make)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from packed(made(batches), dtype in "cz")

        kept = _mirrored(grid, keep) if hermitian else grid.filter(keep)
        tiles = kept.mapInArrow(run, TILE)
        return replace(out, tiles=tiles, source=Source(tiles, kept, make, hermitian))

    @classmethod
    def from_coo(cls, coo: DataFrame, m: int, n: int, mb: int, nb: int, dtype: str = "d") -> TiledMatrix:
        """From coordinates (i, j, re[, im]); each tile's elements meet in one task, a tile at a time."""
        complex_ = dtype in "cz"
        im = F.col("im") if "im" in coo.columns else F.lit(0.0)
        keyed = coo.select(F.expr(f"i div {mb}").alias("ti"), F.expr(f"j div {nb}").alias("tj"), F.expr(f"cast(i % {mb} + (j % {nb}) * least({mb}, {m} - (i div {mb}) * {mb}) as long)").alias("at"), F.col("re").cast("double").alias("re"), im.cast("double").alias("im"))
        dealt = keyed.repartition("ti", "tj").sortWithinPartitions("ti", "tj")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def tiles() -> Iterator[Tile]:
                key, tile = None, None
                for batch in batches:
                    ti, tj, at, re, imag = (batch.column(k).to_numpy() for k in range(5))
                    edges = np.flatnonzero((np.diff(ti) != 0) | (np.diff(tj) != 0)) + 1
                    for lo, hi in zip([0, *edges], [*edges, len(ti)], strict=True):
                        if hi <= lo:
                            continue
                        if key != (ti[lo], tj[lo]):
                            if key is not None:
                                yield key[0], key[1], tile
                            key = ti[lo], tj[lo]
                            tile = np.zeros((min(mb, m - key[0] * mb), min(nb, n - key[1] * nb)), complex if complex_ else float, order="F")
                        np.add.at(tile.reshape(-1, order="F"), at[lo:hi], re[lo:hi] + 1j * imag[lo:hi] if complex_ else re[lo:hi])
                if key is not None:
                    yield key[0], key[1], tile

            yield from packed(tiles(), complex_)

        return cls(dealt.mapInArrow(run, TILE), m, n, mb, nb, dtype)

    def to_coo(self, zeros: bool = True) -> DataFrame:
        """Coordinates (i, j, re, im) of the stored tiles, in DataFrame operations."""
        im = F.when(F.col("im").isNull(), F.lit(0.0)).otherwise(F.expr("im[at]"))
        flat = self.tiles.select("ti", "tj", "nr", "im", F.posexplode("re").alias("at", "re"))
        out = flat.select((F.col("ti") * self.mb + F.expr("at % nr")).alias("i"), (F.col("tj") * self.nb + F.expr("at div nr")).alias("j"), "re", im.alias("im"))
        return out if zeros else out.filter("re != 0 or im != 0")

    # -- tile maps -----------------------------------------------------------------------

    def map_tiles(self, f: Callable[[int, int, np.ndarray], np.ndarray], keep: str = "true", dtype: str | None = None, move: Callable[[int, int], tuple[int, int]] | None = None, **layout: int) -> TiledMatrix:
        """f(ti, tj, tile) for each kept tile; ``move`` gives the new place."""
        dtype = dtype or self.dtype

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from packed(((*(move(ti, tj) if move else (ti, tj)), f(ti, tj, a)) for batch in batches for ti, tj, a in unpack(batch)), dtype in "cz")

        return replace(self, tiles=self.tiles.filter(keep).mapInArrow(run, TILE), dtype=dtype, **layout)

    def fold_tiles(self, f: Callable[[Iterator[Tile]], Iterator[pa.RecordBatch]], schema: str, keep: str = "true") -> DataFrame:
        """Rows that f gives for the kept tiles of a task. A generated matrix's tiles are made in that task and go nowhere else."""
        source = self.source if self.source is not None and self.source.tiles is self.tiles else None
        tiles = _made(source.make) if source else lambda batches: (tile for batch in batches for tile in unpack(batch))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(tiles(batches))

        if not source:
            rows = self.tiles.filter(keep)
        elif source.hermitian:
            rows = _mirrored(source.places, keep)
        else:
            rows = source.places.filter(keep)
        return rows.mapInArrow(run, schema)

    def diagonal(self) -> DataFrame:
        """(i, re, im) of the stored diagonal elements; only tiles that the diagonal crosses are looked at."""
        mb, nb = self.mb, self.nb

        def parts(tiles: Iterator[Tile]) -> Iterator[pa.RecordBatch]:
            for ti, tj, x in tiles:
                k = tj * nb - ti * mb
                if -x.shape[1] < k < x.shape[0]:
                    part, first = np.diagonal(x, -k), max(ti * mb, tj * nb)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(part))), pa.array(part.real.astype(float)), pa.array(part.imag.astype(float))], ["i", "re", "im"])

        return self.fold_tiles(parts, "i long, re double, im double", f"ti * {mb} < (tj + 1) * {nb} and tj * {nb} < (ti + 1) * {mb}")

    def transpose(self, conjugate: bool = False) -> TiledMatrix:
        turn = (lambda ti, tj, a: a.conj().T) if conjugate else (lambda ti, tj, a: a.T)
        return self.map_tiles(turn, move=lambda ti, tj: (tj, ti), m=self.n, n=self.m, mb=self.nb, nb=self.mb)

    def op(self, how: str) -> TiledMatrix:
        return self if how == "N" else self.transpose(conjugate=how == "C")

    def scale(self, factor: complex) -> TiledMatrix:
        if factor == 1:
            return self
        if factor == 0:
            return replace(self, tiles=self.tiles.limit(0))
        return self.map_tiles(lambda ti, tj, a: factor * a)

    def cast_to_complex(self) -> TiledMatrix:
        return replace(self, tiles=self.tiles.withColumn("im", F.transform("re", lambda _: F.lit(0.0))), dtype={"s": "c", "d": "z"}.get(self.dtype, self.dtype))

    def cleared(self, begin: tuple[int, int] = (0, 0), end: tuple[int, int] | None = None) -> TiledMatrix:
        """Zeros in the tiles from ``begin`` to before ``end`` (all by default): these are dropped."""
        to_i, to_j = end or (self.rows.tiles, self.columns.tiles)
        return replace(self, tiles=self.tiles.filter(f"not (ti >= {begin[0]} and ti < {to_i} and tj >= {begin[1]} and tj < {to_j})"))

    def triangle(self, uplo: str, diag: str = "N") -> TiledMatrix:
        """Only the triangle; other tiles are dropped before they move anywhere."""
        from .functions.kernels import triangle

        if uplo == "G":
            return self
        require(self.mb == self.nb, "a triangle needs square tiles")
        compare = ">=" if uplo == "L" else "<="
        return self.map_tiles(lambda ti, tj, a: triangle(a, uplo, diag) if ti == tj else a, keep=f"ti {compare} tj")

    def hermitian(self, uplo: str) -> TiledMatrix:
        """The full Hermitian matrix of which a triangle is stored."""
        from .functions.kernels import full

        require(self.m == self.n and self.mb == self.nb, "a Hermitian matrix is square, with square tiles")
        if uplo == "G":
            return self
        side = self.map_tiles(lambda ti, tj, a: full(a, uplo) if ti == tj else a, keep=f"ti {'>=' if uplo == 'L' else '<='} tj")
        mirror = replace(side, tiles=self.tiles.filter("ti != tj").filter(f"ti {'>' if uplo == 'L' else '<'} tj")).transpose(conjugate=True)
        return replace(side, tiles=side.tiles.unionAll(mirror.tiles))

    # -- cutting and pasting -------------------------------------------------------------

    def window(self, origin: tuple[int, int], size: tuple[int, int], at: tuple[int, int] = (0, 0), shape: tuple[int, int] | None = None, tile: tuple[int, int] | None = None) -> TiledMatrix:
        """A rectangle, put at a place of a matrix of some shape and tile size (zeros around it)."""
        (r, c), (h, w), (to_r, to_c) = origin, size, at
        require(0 <= r and 0 <= c and h >= 0 and w >= 0 and r + h <= self.m and c + w <= self.n, "the rectangle isn't inside the matrix")
        m, n = shape or size
        require(to_r >= 0 and to_c >= 0 and to_r + h <= m and to_c + w <= n, "the rectangle doesn't fit its place")
        mb, nb = tile or (self.mb, self.nb)
        old_mb, old_nb, complex_ = self.mb, self.nb, self.complex
        inside = f"(ti + 1) * {old_mb} > {r} and ti * {old_mb} < {r + h} and (tj + 1) * {old_nb} > {c} and tj * {old_nb} < {c + w}"

        def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A piece travels as a tile whose size and place in its new tile come first.
            def cut() -> Iterator[Tile]:
                for batch in batches:
                    for ti, tj, a in unpack(batch):
                        top, left = ti * old_mb, tj * old_nb
                        i0, i1, j0, j1 = max(top, r), min(top + a.shape[0], r + h), max(left, c), min(left + a.shape[1], c + w)
                        i = i0
                        while i < i1:
                            row = i - r + to_r
                            ni = min(i1, i + mb - row % mb)
                            j = j0
                            while j < j1:
                                column = j - c + to_c
                                nj = min(j1, j + nb - column % nb)
                                yield row, column, a[i - top : ni - top, j - left : nj - left]
                                j = nj
                            i = ni

            yield from packed(cut(), complex_)

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def paste() -> Iterator[Tile]:
                key, tile = None, None
                for batch in batches:
                    for row, column, a in unpack(batch):
                        if key != (row // mb, column // nb):
                            if key is not None:
                                yield key[0], key[1], tile
                            key = row // mb, column // nb
                            tile = np.zeros((min(mb, m - key[0] * mb), min(nb, n - key[1] * nb)), complex if complex_ else float)
                        tile[row % mb : row % mb + a.shape[0], column % nb : column % nb + a.shape[1]] = a
                if key is not None:
                    yield key[0], key[1], tile

            yield from packed(paste(), complex_)

        cut = self.tiles.filter(inside).mapInArrow(pieces, TILE)
        if (mb, nb) == (old_mb, old_nb) and (to_r - r) % mb == 0 and (to_c - c) % nb == 0 and r + h in (self.m, *range(0, self.m + mb, mb)) and c + w in (self.n, *range(0, self.n + nb, nb)) and r % mb == c % nb == 0 and to_r + h in (m, *range(0, m + mb, mb)) and to_c + w in (n, *range(0, n + nb, nb)):
            # Whole tiles only change their names: nothing is shuffled.
            tiles = self.tiles.filter(inside).withColumn("ti", F.col("ti") + (to_r - r) // mb).withColumn("tj", F.col("tj") + (to_c - c) // nb)
            return replace(self, tiles=tiles, m=m, n=n)
        key = [F.expr(f"ti div {mb}"), F.expr(f"tj div {nb}")]
        tiles = cut.repartition(*key).sortWithinPartitions(*key).mapInArrow(joined, TILE)
        return replace(self, tiles=tiles, m=m, n=n, mb=mb, nb=nb)

    def submatrix(self, i: int, j: int, m: int, n: int) -> TiledMatrix:
        return self.window((i, j), (m, n))

    def retile(self, mb: int, nb: int) -> TiledMatrix:
        return self.window((0, 0), (self.m, self.n), tile=(mb, nb))

    def stored(self, name: str = "matrix") -> TiledMatrix:
        return replace(self, tiles=stored(self.tiles, name))


def summed(tiles: DataFrame, complex_: bool) -> DataFrame:
    """Sums of the tiles of each place; a task holds one place's sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums() -> Iterator[Tile]:
            key, total = None, None
            for batch in batches:
                for ti, tj, a in unpack(batch):
                    if key == (ti, tj):
                        total = total + a
                    else:
                        if key is not None:
                            yield *key, total
                        key, total = (ti, tj), a
            if key is not None:
                yield *key, total

        yield from packed(sums(), complex_)

    return tiles.repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(run, TILE)


def in_one_task(f: Callable[..., list[np.ndarray]], inputs: list[TiledMatrix], outputs: list[TiledMatrix]) -> list[TiledMatrix]:
    """f of the dense inputs, in one task on an executor; outputs carry shapes and types."""
    spark = outputs[0].spark
    rows = spark.createDataFrame([(-1,)], "which int").selectExpr("which", "0L ti", "0L tj", "0 nr", "0 nc", "array(0D) re", "cast(null as array<double>) im")
    for k, a in enumerate(inputs):
        rows = rows.unionAll(a.tiles.selectExpr(f"{k} which", "ti", "tj", "nr", "nc", "re", "im"))
    bare_in, bare_out = ([replace(a, tiles=None) for a in x] for x in (inputs, outputs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = [np.zeros((a.m, a.n), a.numpy_type) for a in bare_in]
        for batch in batches:
            real = batch.slice(0, 0) if not batch.num_rows else batch.take(pa.array(np.flatnonzero(batch.column(0).to_numpy() >= 0)))
            for k, (ti, tj, x) in zip(real.column(0).to_pylist(), unpack(real, 1), strict=True):
                a = bare_in[k]
                arrays[k][ti * a.mb : ti * a.mb + x.shape[0], tj * a.nb : tj * a.nb + x.shape[1]] = x if a.complex else x.real
        for k, (a, result) in enumerate(zip(bare_out, f(*arrays), strict=True)):
            for out in packed(a.split(np.asarray(result)), a.complex):
                yield pa.RecordBatch.from_arrays([pa.array([k] * out.num_rows, pa.int32()), *out.columns], ["which", *out.schema.names])

    done = rows.repartition(1).mapInArrow(run, f"which int, {TILE}")
    if len(outputs) > 1:
        done = stored(done, "task")
    return [replace(a, tiles=done.filter(F.col("which") == k).drop("which")) for k, a in enumerate(outputs)]

