"""Band to tridiagonal by groups of sweeps that follow each other through the band, and the back-transformation.

The band lies in blocks of ``band`` rows. A group of sweeps works on a window of the band; the next group may enter a window as soon as
the group before is two windows ahead, so the groups form a wavefront: in each wave every window in work is one task.
Within a group, the window of a sweep begins two bands earlier than that of the sweep before: a step waits for those of earlier sweeps
that begin less than two bands below it, and for no others. The driver holds the diagonals; reflectors are a dataset.

For the back-transformation, the reflectors that start at one step of successive sweeps form a skewed block with a triangular factor
(compact WY). Blocks of columns of the eigenvectors meet all these in their order, in a single shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import spectral as S
from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, pack, packed, unpack
from ..plans.strategy import Scratch, stored

#: Numbers of the band that one task may hold: up to this, one group makes all sweeps.
HELD = 4 << 20
#: Waves at most, by default: a group has as many sweeps as that takes.
WAVES = 256
#: Sweeps of a block of reflectors, at most.
GROUP = 64
#: Numbers of a block of columns of the eigenvectors.
COLUMNS_HELD = 16 << 20


@dataclass(frozen=True)
class Reflectors:
    """Tiles (sweep, step): one column that holds v and then tau."""

    frame: DataFrame
    n: int
    band: int
    complex: bool


def outside_band(matrix: TiledMatrix, band: int) -> int:
    """The first column with an element that isn't zero more than ``band`` rows below the diagonal; the order, if there is none."""
    mb, nb = matrix.mb, matrix.nb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = matrix_n
        for batch in batches:
            for ti, tj, x in unpack(batch):
                i, j = np.nonzero(x)
                far = j[i + ti * mb - j - tj * nb > band]
                least = min(least, tj * nb + int(far.min(initial=matrix_n)))
        yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64())], ["j"])

    matrix_n = matrix.n
    found = matrix.tiles.filter(f"(ti + 1) * {mb} - tj * {nb} > {band + 1}").mapInArrow(run, "j long").agg(F.min("j")).first()[0]
    return matrix_n if found is None else found


def stored_band(matrix: TiledMatrix, band: int) -> TiledMatrix:
    """The diagonals of a band matrix by rows, each row shifted so that its diagonal element is in the middle; room for the fill-in."""
    near = replace(matrix, tiles=matrix.tiles.filter(f"abs(ti - tj) * {matrix.nb} < {band + matrix.nb}"))
    rows = near.to_coo(False).filter(f"abs(i - j) <= {band}").selectExpr("i", f"j - i + {2 * band} j", "re", "im")
    return TiledMatrix.from_coo(rows, matrix.n, 4 * band + 1, band, 4 * band + 1, matrix.dtype)


def windows(wave: int, n: int, band: int, group: int, count: int) -> list[tuple[int, int, int, int]]:
    """(group, position, first row, end) of the windows in work in a wave; they don't touch."""
    width = band * (2 * group + 3)
    positions = (n - 1 + 2 * band * (group - 1)) // width + 1
    lag, out = (2 if positions > 1 else 1), []
    for g in range(min(-(-count // group), wave // lag + 1)):
        p = wave - lag * g
        if (g * group + 1) // width <= p < positions:
            out.append((g, p, max(0, p * width - 2 * band * group - band), min(n, (p + 1) * width + 2 * band)))
    return out


def _wave(rows: TiledMatrix, work: list[tuple[int, int, int, int]], n: int, band: int, group: int, count: int) -> DataFrame:
    """The rows after a wave (tj = -1), and its reflectors (tj: their step)."""
    spark, complex_, width = rows.spark, rows.complex, band * (2 * group + 3)
    blocks = [(k, g) for g, _, lo, hi in work for k in range(lo // band, -(-hi // band))]
    place = {g: (p, lo) for g, p, lo, _ in work}
    # One row for each block of the band in work.
    active = rows.tiles.join(F.broadcast(spark.createDataFrame(blocks, "ti long, g long")), "ti").select(*rows.tiles.columns, "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows_of() -> Iterator[tuple[int, dict[int, np.ndarray]]]:
            now, held = None, {}
            for batch in batches:
                for (ti, _, x), g in zip(unpack(batch), batch.column(6).to_pylist(), strict=True):
                    if g != now:
                        if now is not None:
                            yield now, held
                        now, held = g, {}
                    held[ti] = x
            if now is not None:
                yield now, held

        def out() -> Iterator[Tile]:
            for g, held in windows_of():
                p, lo = place[g]
                end = max(ti * band + len(x) for ti, x in held.items())
                window = np.zeros((end - lo, 4 * band + 1), complex if complex_ else float)
                for ti, x in held.items():
                    window[ti * band - lo : ti * band - lo + len(x)] = x
                bounds = lambda sweep: (p * width - 2 * band * (sweep - g * group), (p + 1) * width - 2 * band * (sweep - g * group))
                for sweep, step, _, v, tau in S.chase_part(window, lo, n, band, range(g * group, min(count, (g + 1) * group)), bounds):
                    yield sweep, step, np.append(v, tau)[:, None]
                for k in range(lo, end, band):
                    yield k // band, -1, window[k - lo : k - lo + band]

        yield from packed(out(), complex_)

    done = active.repartition(len(work), "g").sortWithinPartitions("g", "ti").mapInArrow(run, TILE)
    idle = rows.tiles.filter("not (" + " or ".join(f"ti >= {lo // band} and ti < {-(-hi // band)}" for _, _, lo, hi in work) + ")")
    return done.unionAll(idle.withColumn("tj", F.lit(-1).cast("long")))


def chase_bulges(matrix: TiledMatrix, band: int, group: int | None = None) -> tuple[np.ndarray, np.ndarray, Reflectors]:
    """Diagonal, off-diagonal and reflectors of the tridiagonal matrix; ``group``: sweeps that one task makes in its window.

    A real matrix that is tridiagonal already needs no sweep.
    """
    n, spark, complex_ = matrix.n, matrix.spark, matrix.complex
    count = S.sweeps(n, complex_)
    if not complex_ and outside_band(matrix, 1) == n:
        return *_two_diagonals(matrix), Reflectors(spark.createDataFrame([], TILE), n, band, False)
    if group is None:
        group = max(1, count if n * (4 * band + 1) <= HELD else -(-2 * count // WAVES))
    require(group >= 1, "a group has a sweep or more")
    with Scratch(spark) as scratch:
        rows = stored_band(matrix, band)
        whole = replace(rows, tiles=scratch.stored(_all_blocks(rows).withColumn("tj", F.lit(-1).cast("long"))))
        groups = -(-count // group)
        for wave in range(2 * groups + n):
            if work := windows(wave, n, band, group, count):
                whole = replace(whole, tiles=scratch.stored(_wave(whole, work, n, band, group, count)).filter("tj < 0"))
            elif wave >= 2 * groups:
                break
        # All waves' tables: each holds its own reflectors beside the rows.
        made = spark.read.schema(whole.tiles.schema).parquet(*(f"{scratch.folder}/{k:06d}" for k in range(1, scratch.made + 1)))
        reflectors = made.filter("tj >= 0")
        reflectors = stored(reflectors, "reflectors")
        d, e = _diagonals(whole, band)
    return d, e, Reflectors(reflectors, n, band, complex_)


def _all_blocks(rows: TiledMatrix) -> DataFrame:
    """Blocks of zeros may be missing; bulges pass through them too."""
    zeros = TiledMatrix.generate(rows.spark, rows.m, rows.n, rows.mb, rows.nb, lambda i, j: np.zeros((i.size, j.size)), rows.dtype)
    return rows.tiles.unionAll(zeros.tiles.join(rows.tiles.select("ti"), "ti", "left_anti").select(*rows.tiles.columns))


def _diagonals(rows: TiledMatrix, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each row."""
    n = rows.m
    d, e = np.zeros(n), np.zeros(n)
    at = lambda k: F.expr(f"slice(re, {k} * nr + 1, nr)")
    for r in rows.tiles.select("ti", at(2 * band).alias("d"), at(2 * band - 1).alias("e")).toLocalIterator():
        d[r.ti * band : r.ti * band + len(r.d)], e[r.ti * band : r.ti * band + len(r.e)] = r.d, r.e
    return d, e[1:]


def _two_diagonals(matrix: TiledMatrix) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the one below it, of a real matrix: two numbers for each row."""
    n, mb, nb = matrix.n, matrix.mb, matrix.nb

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            for batch in batches:
                for ti, tj, x in unpack(batch):
                    for below in (0, 1):
                        k = tj * nb - ti * mb + below  # this far below the tile's own diagonal
                        if -x.shape[1] < k < x.shape[0]:
                            yield tj * nb + max(0, -k), below, np.diagonal(x, -k)[:, None]

        yield from packed(tiles(), False)

    out = np.zeros((2, n))
    near = matrix.tiles.filter(f"abs(ti * {mb} - tj * {nb}) <= {max(mb, nb)}")
    for batch in near.mapInArrow(run, TILE).toArrow().to_batches():
        for at, below, x in unpack(batch):
            out[below, at : at + len(x)] = x[:, 0]
    return out[0], out[1, : n - 1]


def blocks_of(reflectors: Reflectors, group: int | None = None) -> DataFrame:
    """Steps for ``apply_steps``: skewed blocks of the reflectors of ``group`` successive sweeps at one step, with their factors."""
    band, n, complex_ = reflectors.band, reflectors.n, reflectors.complex
    group = min(band, group or GROUP)
    steps = -(-n // band) + 1
    last = -(-n // group)
    keyed = reflectors.frame.withColumn("block", F.expr(f"ti div {group}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: tuple[int, int], columns: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            block, step = key
            first = block * group + 1 + step * band
            v = np.zeros((max(sweep - block * group + len(x) - 1 for sweep, x in columns), len(columns)), complex if complex_ else float)
            for k, (sweep, x) in enumerate(columns):
                v[sweep - block * group : sweep - block * group + len(x) - 1, k] = x[:-1]
            t = K.larft(v, np.array([x[-1] for _, x in columns]))
            batch = pack([(first, 0, v), (first, 1, t)], complex_)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([(last - block) * steps + step] * 2, pa.int64())], [*batch.schema.names, "seq"])

        now, held = None, []
        for batch in batches:
            for (sweep, step, x), block in zip(unpack(batch), batch.column(6).to_pylist(), strict=True):
                if now != (block, step):
                    if now is not None:
                        yield out(now, held)
                    now, held = (block, step), []
                held.append((sweep, x[:, 0]))
        if now is not None:
            yield out(now, held)

    return keyed.repartition("block", "tj").sortWithinPartitions("block", "tj", "ti").mapInArrow(run, f"{TILE}, seq long")


def apply_steps(e: TiledMatrix, steps: DataFrame, complex_: bool) -> TiledMatrix:
    """E after the steps in the order of ``seq``: each is 1 - V T Vᴴ, V in pieces (ti: first row, tj = 0) and then T (tj = 1)."""
    if complex_ and not e.complex:
        e = e.cast_to_complex()
    per = max(1, min(COLUMNS_HELD // max(1, e.m * e.nb), -(-e.columns.tiles // e.spark.sparkContext.defaultParallelism)))
    count = max(1, -(-e.columns.tiles // per))
    bare, kind = replace(e, tiles=None), e.numpy_type
    mine = e.tiles.withColumns({"seq": F.lit(-1).cast("long"), "col": F.expr(f"tj div {per}")})
    theirs = steps.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            now, block, pieces = None, None, []
            for batch in batches:
                for (ti, tj, x), seq, col in zip(unpack(batch), batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True):
                    if col != now:
                        if block is not None:
                            yield from cut(now, block)
                        now, block, pieces = col, None, []
                    if seq < 0:
                        if block is None:
                            block = np.zeros((bare.m, min(per * bare.nb, bare.n - col * per * bare.nb)), kind, order="F")
                        left = (tj - col * per) * bare.nb
                        block[ti * bare.mb : ti * bare.mb + x.shape[0], left : left + x.shape[1]] = x
                    elif block is None:
                        continue  # columns of zeros stay
                    elif tj == 0:
                        pieces.append((ti, x))
                    else:
                        w = x @ sum(v.conj().T @ block[first : first + len(v)] for first, v in pieces)
                        for first, v in pieces:
                            block[first : first + len(v)] -= v @ w
                        pieces = []
            if block is not None:
                yield from cut(now, block)

        def cut(col: int, block: np.ndarray) -> Iterator[Tile]:
            for j in range(0, block.shape[1], bare.nb):
                for i in range(0, bare.m, bare.mb):
                    yield i // bare.mb, col * per + j // bare.nb, block[i : i + bare.mb, j : j + bare.nb]

        yield from packed(tiles(), bare.complex)

    both = mine.unionByName(theirs).select(*e.tiles.columns, "seq", "col")
    return replace(e, tiles=both.repartition(count, "col").sortWithinPartitions("col", "seq", "tj", "ti").mapInArrow(run, TILE))
