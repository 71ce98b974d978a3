"""Divide and conquer for tridiagonal matrices whose eigenvectors stay in tiles.

Leaves are solved in tasks. The merges of one level of the tree run side by side, in three jobs: the rows of the
eigenvectors at the cuts are gathered (n numbers); roots of the secular equations are dealt over tasks in
ranges, each range also giving its share of the logs of the weights; and each strip of rows of the eigenvectors meets its
merge's small tables in a task and becomes a strip of the merged eigenvectors. The driver holds poles, weights and roots
(a few numbers for each row), a task a strip (tile rows x order) and a part of the inner eigenvectors.

Where only eigenvalues are asked for, the same tree is merged with the first and the last row of each part's eigenvectors, which
is all that a merge reads of them: n numbers each, and no table is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral as S
from ..layout import require
from ..matrix import TILE, Tile, TiledMatrix, packed, unpack
from ..plans.strategy import BROADCAST_BYTES, Scratch, stored

#: Order of a leaf, at most.
LEAF = 1024
#: Differences of poles and roots that a task holds at once.
HELD = 1 << 21
#: Numbers of a block of inner products that a task sums up.
PRODUCTS_HELD = 1 << 23

UPPER, DENSE, LOWER, DEFLATED = 0, 1, 2, 3


def column_types(first: int, count: int, rotations: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Types of a merge's columns: zero below the cut (upper), above it (lower), or neither (dense), unless deflated.

    The first ``first`` columns belong to the part above the cut. Columns that a rotation mixes across the cut become dense.
    """
    types = np.where(np.arange(count) < first, UPPER, LOWER)
    for p, i in rotations[:, :2].astype(int):
        if types[p] != types[i]:
            types[p] = types[i] = DENSE
    return np.where(live, types, DEFLATED)


def typed_columns(order: np.ndarray, upper: int, dense: int, side: str) -> np.ndarray:
    """Of columns ordered by type (upper, dense, lower), those that aren't zero above the cut, below it, or in both."""
    return {"above": order[: upper + dense], "below": order[upper:], "both": order}[side]


def _strips(tiles: DataFrame, parts: int, columns_of: Callable[[int], tuple[int, int]], nb: int, f: Callable[[int, np.ndarray], Iterator[Tile]], complex_: bool) -> DataFrame:
    """f(tile row, strip) for each row of tiles; columns_of gives the range of columns of a row's strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            now, strip = None, None
            for batch in batches:
                for ti, tj, x in unpack(batch):
                    if ti != now:
                        if now is not None:
                            yield from f(now, strip)
                        now, (begin, end) = ti, columns_of(ti)
                        strip = np.zeros((x.shape[0], end - begin), complex if complex_ else float, order="F")
                    strip[:, tj * nb - begin : tj * nb - begin + x.shape[1]] = x
            if now is not None:
                yield from f(now, strip)

        yield from packed(tiles(), complex_)

    # The number of partitions is given: tasks are long though their input is small.
    return tiles.repartition(parts, "ti").sortWithinPartitions("ti").mapInArrow(run, TILE)


def _parts(spark: SparkSession, most: int) -> int:
    return max(1, min(most, 4 * spark.sparkContext.defaultParallelism, 10_000))


def typed_product(q: TiledMatrix, split: int, types: np.ndarray, u: Callable[[np.ndarray, np.ndarray], np.ndarray], columns: int, work: Accumulator | None = None) -> TiledMatrix:
    """Q U where columns of Q are zero below row ``split`` (type UPPER), above it (LOWER) or dense (DENSE).

    U's elements are u(i, j) of index arrays, i being a column of Q; they are made where they are needed. Rows above the cut meet
    only upper and dense columns, rows below it dense and lower ones. ``work`` counts the multiplications.
    """
    require(len(types) == q.n and 0 <= split <= q.m, "each column needs a type, the cut lies inside the matrix")
    order = np.argsort(types, kind="stable")
    upper, dense = int((types == UPPER).sum()), int((types == DENSE).sum())
    mb, nb = q.mb, q.nb

    def product(ti: int, strip: np.ndarray) -> Iterator[Tile]:
        side = "above" if ti * mb + len(strip) <= split else "below" if ti * mb >= split else "both"
        inner = typed_columns(order, upper, dense, side)
        left = strip[:, inner]
        if side == "both":  # a strip across the cut
            rows = np.arange(ti * mb, ti * mb + len(strip))[:, None]
            left = np.where((rows < split) & (types[inner] == LOWER) | (rows >= split) & (types[inner] == UPPER), 0, left)
        for tj in range(0, columns, nb):
            j = np.arange(tj, min(tj + nb, columns))
            if work is not None:
                work.add(left.size * len(j))
            yield ti, tj // nb, left @ np.broadcast_to(u(inner[:, None], j[None, :]), (len(inner), len(j)))

    across = q.n
    tiles = _strips(q.tiles, _parts(q.spark, q.rows.tiles), lambda ti: (0, across), nb, product, q.complex)
    return replace(q, tiles=tiles, n=columns)


@dataclass
class Merge:
    """One merge: rows begin..end, cut at split; its columns are numbered from begin."""

    begin: int
    split: int
    end: int
    rho: float
    rotations: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    order: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # live columns by type
    ascending: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # live columns by pole
    upper: int = 0
    dense: int = 0
    poles: np.ndarray = field(default_factory=lambda: np.zeros(0))  # live, ascending
    z: np.ndarray = field(default_factory=lambda: np.zeros(0))
    by_type: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # ascending places in the order by type
    dead: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # deflated columns
    dead_values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pole: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    out: np.ndarray = field(default_factory=lambda: np.zeros(0, int))  # a root's number, or the roots' number plus a deflated column's

    def prepare(self, d: np.ndarray, z: np.ndarray) -> None:
        """Deflation and types: what is left are ``poles`` and ``z``."""
        order, d, z, live, rotations = S.deflate(d, z, self.rho)
        self.rotations = np.array([(order[p], order[i], c, s) for p, i, c, s in rotations], float).reshape(-1, 4)
        alive = np.zeros(len(d), bool)
        alive[order] = live
        types = column_types(self.split - self.begin, len(d), self.rotations, alive)
        at = np.flatnonzero(live)
        self.poles, self.z, self.ascending = d[at], z[at], order[at]
        self.by_type = np.argsort(types[order[at]], kind="stable")
        self.order = order[at][self.by_type]
        self.upper, self.dense = int((types == UPPER).sum()), int((types == DENSE).sum())
        self.dead, self.dead_values = order[~live], d[~live]

    def finish(self) -> np.ndarray:
        """The merged eigenvalues, ascending."""
        values = np.concatenate((self.poles[self.pole] + self.shift, self.dead_values))
        self.out = np.argsort(values, kind="stable")
        return values[self.out]

    def inner(self, roots: np.ndarray) -> np.ndarray:
        """Unit eigenvectors of the small problem for some roots; rows by type."""
        poles, weight = self.poles[self.by_type], self.weight[self.by_type]
        u = weight[:, None] / ((poles[:, None] - self.poles[self.pole[roots]][None, :]) - self.shift[roots][None, :])
        return u / np.linalg.norm(u, axis=0)

    def rotate(self, q: np.ndarray) -> None:
        """The deflation's rotations of the columns, in place."""
        for p, i, c, s in self.rotations:
            S.rotate(q, int(p), int(i), c, s)

    def columns(self, q: np.ndarray, left: np.ndarray, used: slice, lo: int, hi: int) -> np.ndarray:
        """Columns lo..hi of merged rows, from rotated rows q and their live columns that are ``used``."""
        k, which = len(self.poles), self.out[lo:hi]
        at_once = max(1, HELD // max(k, 1))
        out = np.zeros((len(q), len(which)))
        copied = np.flatnonzero(which >= k)
        out[:, copied] = q[:, self.dead[which[copied] - k]]
        roots = np.flatnonzero(which < k)
        for part in range(0, len(roots), at_once):
            some = roots[part : part + at_once]
            out[:, some] = left @ self.inner(which[some])[used]
        return out

    def strip(self, q: np.ndarray, above: bool, nb: int) -> Iterator[np.ndarray]:
        """Blocks of nb columns of the merged strip, from a strip of the eigenvectors above or below the cut."""
        self.rotate(q)
        left = q[:, typed_columns(self.order, self.upper, self.dense, "above" if above else "below")]
        used = slice(0, self.upper + self.dense) if above else slice(self.upper, None)
        for lo in range(0, q.shape[1], nb):
            yield self.columns(q, left, used, lo, min(lo + nb, q.shape[1]))


def solve_secular(spark: SparkSession, merges: list[Merge], at_once: int = HELD) -> None:
    """Roots and weights of all merges: ranges of roots are dealt over tasks, logs of weights are summed over them."""
    chunks = []
    for m, merge in enumerate(merges):
        k = len(merge.poles)
        step = max(1, min(at_once // max(k, 1), -(-k // spark.sparkContext.defaultParallelism)))
        chunks += [(m, lo, min(lo + step, k)) for lo in range(0, k, step)]
    if not chunks:
        return
    # Poles and weights: two numbers for each row.
    require(sum(m.poles.nbytes + m.z.nbytes for m in merges) <= BROADCAST_BYTES, "the order is too large for a broadcast of poles")
    sent = spark.sparkContext.broadcast([(m.poles, m.z, m.rho) for m in merges])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                poles, z, rho = sent.value[m]
                pole, shift = S.secular_range(poles, z, rho, lo, hi)
                part = S.weight_logs(poles, rho, lo, pole, shift)
                logs[m] = part if m not in logs else logs[m] + part
                yield pa.RecordBatch.from_arrays([pa.array([m] * (hi - lo), pa.int32()), pa.array([True] * (hi - lo)), pa.array(range(lo, hi), pa.int64()), pa.array(pole, pa.float64()), pa.array(shift)], ["m", "root", "at", "v", "w"])
        for m, part in logs.items():
            yield pa.RecordBatch.from_arrays([pa.array([m] * len(part), pa.int32()), pa.array([False] * len(part)), pa.array(range(len(part)), pa.int64()), pa.array(part), pa.array(np.zeros(len(part)))], ["m", "root", "at", "v", "w"])

    rows = spark.createDataFrame(chunks, "m int, lo long, hi long").repartition(_parts(spark, len(chunks)))
    found = rows.mapInArrow(run, "m int, root boolean, at long, v double, w double").groupBy("m", "root", "at").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).toArrow()
    m_, root, at, v, w = (found.column(c).to_numpy() for c in ("m", "root", "at", "v", "w"))
    for m, merge in enumerate(merges):
        mine = m_ == m
        k = len(merge.poles)
        merge.pole, merge.shift, logs = np.zeros(k, int), np.zeros(k), np.zeros(k)
        merge.pole[at[mine & root]], merge.shift[at[mine & root]] = v[mine & root].astype(int), w[mine & root]
        logs[at[mine & ~root]] = v[mine & ~root]
        merge.weight = np.copysign(np.exp(logs / 2), merge.z)


def _leaves(spark: SparkSession, d: np.ndarray, e: np.ndarray, edges: list[int], nb: int) -> DataFrame:
    """Tiles of the leaves' eigenvectors; rows of ti = -1 hold a leaf's eigenvalues."""
    sent = spark.sparkContext.broadcast((d, e, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            d, e, edges = sent.value
            for batch in batches:
                for leaf in batch.column(0).to_pylist():
                    lo, hi = edges[leaf], edges[leaf + 1]
                    values, vectors = S.tridiagonal_eigensolver(d[lo:hi], e[lo : hi - 1])
                    yield -1, leaf, values[:, None]
                    for i in range(0, hi - lo, nb):
                        for j in range(0, hi - lo, nb):
                            yield (lo + i) // nb, (lo + j) // nb, vectors[i : i + nb, j : j + nb]

        yield from packed(tiles(), False)

    count = len(edges) - 1
    return spark.range(0, count, 1, _parts(spark, count)).mapInArrow(run, TILE)


def _rows_at_cuts(q: DataFrame, rows: set[int], nb: int, n: int) -> dict[int, np.ndarray]:
    """Some rows of the eigenvectors: for each cut, its last row above and its first row below."""
    wanted = sorted(rows)
    by_tile: dict[int, list[int]] = {}
    for r in wanted:
        by_tile.setdefault(r // nb, []).append(r % nb)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(((ti * nb + r, tj, x[r : r + 1]) for batch in batches for ti, tj, x in unpack(batch) for r in by_tile[ti]), False)

    out = {r: np.zeros(n) for r in wanted}
    for batch in q.filter(F.col("ti").isin(list(by_tile))).mapInArrow(run, TILE).toArrow().to_batches():
        for r, tj, x in unpack(batch):
            out[r][tj * nb : tj * nb + x.shape[1]] = x[0]
    return out


def levels(leaves: int) -> list[list[tuple[int, int, int]]]:
    """The merges of the tree by level: those of one level don't wait for each other."""
    height: dict[tuple[int, int], int] = {}
    out: list[list[tuple[int, int, int]]] = []
    for begin, split, end in S.merge_order(leaves):
        level = max(height.get((begin, split), 0), height.get((split, end), 0))
        height[begin, end] = level + 1
        while len(out) <= level:
            out.append([])
        out[level].append((begin, split, end))
    return out


def _cut(d: np.ndarray, e: np.ndarray, nb: int, leaf: int | None) -> tuple[np.ndarray, list[int], list[list[tuple[int, int, int]]]]:
    """The diagonal of the leaves, their edges, and the merges of the tree by level."""
    n, d = len(d), np.array(d, float)
    if leaf is None:  # four leaves or more, if there are so many tiles
        leaf = nb * max(1, min(LEAF // nb, n // (4 * nb)))
    require(leaf % nb == 0, "a leaf consists of whole tiles")
    edges = [*range(0, n, leaf), n]
    tree = levels(len(edges) - 1)
    for split in (edges[s] for level in tree for _, s, _ in level):
        d[split - 1] -= abs(e[split - 1])
        d[split] -= abs(e[split - 1])
    return d, edges, tree


def _weights(coupling: float, last: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A merge's z, from the last row above its cut and the first row below it."""
    return np.concatenate((np.copysign(1.0, coupling) * last, first)) / np.sqrt(2)


def _leaf_ends(spark: SparkSession, d: np.ndarray, e: np.ndarray, edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The leaves' eigenvalues, and the first and last rows of their eigenvectors."""
    sent = spark.sparkContext.broadcast((d, e, edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tiles() -> Iterator[Tile]:
            d, e, edges = sent.value
            for batch in batches:
                for leaf in batch.column(0).to_pylist():
                    lo, hi = edges[leaf], edges[leaf + 1]
                    values, vectors = S.tridiagonal_eigensolver(d[lo:hi], e[lo : hi - 1])
                    yield leaf, 0, np.stack((values, vectors[0], vectors[-1]))

        yield from packed(tiles(), False)

    count, values, ends = len(edges) - 1, d.copy(), np.zeros((2, len(d)))
    # Three numbers for each row come to the driver.
    for batch in spark.range(0, count, 1, _parts(spark, count)).mapInArrow(run, TILE).toArrow().to_batches():
        for leaf, _, x in unpack(batch):
            values[edges[leaf] : edges[leaf + 1]], ends[:, edges[leaf] : edges[leaf + 1]] = x[0], x[1:]
    return values, ends


def _by_ranges(spark: SparkSession, counts: list[int], sent: list, f: Callable[[tuple, int, int], np.ndarray], rows: int) -> list[np.ndarray]:
    """f(what is sent of a merge, lo, hi): ``rows`` numbers for each of a merge's live poles, in ranges dealt over tasks."""
    # What goes to the tasks and comes back are a few numbers for each row.
    require(sum(x.nbytes for part in sent for x in part if isinstance(x, np.ndarray)) <= BROADCAST_BYTES, "the order is too large for a broadcast of poles")
    step = max(LEAF, -(-sum(counts) // (4 * spark.sparkContext.defaultParallelism)))
    chunks = [(m, lo, min(lo + step, k)) for m, k in enumerate(counts) for lo in range(0, k, step)]
    out = [np.zeros((rows, k)) for k in counts]
    if not chunks:
        return out
    shared = spark.sparkContext.broadcast(sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = (p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from packed(((m, lo, f(shared.value[m], lo, hi)) for m, lo, hi in places), False)

    dealt = spark.createDataFrame(chunks, "m int, lo long, hi long").repartition(_parts(spark, len(chunks)))
    for batch in dealt.mapInArrow(run, TILE).toArrow().to_batches():
        for m, lo, x in unpack(batch):
            out[m][:, lo : lo + x.shape[1]] = x
    shared.unpersist()
    return out


def _solve_roots(spark: SparkSession, merges: list[Merge]) -> None:
    """Roots of all merges, without their weights."""
    found = _by_ranges(spark, [len(m.poles) for m in merges], [(m.poles, m.z, m.rho) for m in merges], lambda x, lo, hi: np.stack(S.secular_range(*x, lo, hi)), 2)
    for m, (pole, shift) in zip(merges, found, strict=True):
        m.pole, m.shift = pole.astype(int), shift


def _merged_ends(spark: SparkSession, merges: list[Merge], ends: np.ndarray) -> None:
    """Weights, and the first and last rows of the merged eigenvectors in place: ranges of poles and of columns are dealt over tasks."""
    counts = [len(m.poles) for m in merges]
    logs = _by_ranges(spark, counts, [(m.poles, m.rho, m.pole, m.shift) for m in merges], lambda x, lo, hi: S.range_of_weight_logs(*x, lo, hi)[None, :], 1)
    rows = []
    for m, (part,) in zip(merges, logs, strict=True):
        m.weight = np.copysign(np.exp(part / 2), m.z)
        q = ends[:, m.begin : m.end].copy()
        # A part's own zeros: its first row ends at the cut, its last row begins there.
        q[0, m.split - m.begin :] = 0
        q[1, : m.split - m.begin] = 0
        m.rotate(q)
        rows.append(q)
    sent = [(m.poles, m.weight, np.ascontiguousarray(q[:, m.ascending]), m.pole, m.shift) for m, q in zip(merges, rows, strict=True)]
    merged = _by_ranges(spark, counts, sent, lambda x, lo, hi: S.range_of_rows(*x, lo, hi), 2)
    for m, q, live in zip(merges, rows, merged, strict=True):
        ends[:, m.begin : m.end] = np.hstack((live, q[:, m.dead]))[:, m.out]


def eigenvalues(spark: SparkSession, d: np.ndarray, e: np.ndarray, nb: int, leaf: int | None = None) -> np.ndarray:
    """Ascending eigenvalues of the tridiagonal matrix, by the tree of ``divide_and_conquer`` without its eigenvectors.

    A part's eigenvectors take part in a merge by their rows at the cut only, so the first and the last row are carried. A merge of k poles
    takes about k^1.5 operations: what is far from a range of roots is summed at a few points.
    """
    if not len(d):
        return np.array(d, float)
    e = np.asarray(e, float)
    d, edges, tree = _cut(d, e, nb, leaf)
    values, ends = _leaf_ends(spark, d, e, edges)
    for level in tree:
        merges = [Merge(edges[b], edges[s], edges[x], 2 * abs(e[edges[s] - 1])) for b, s, x in level]
        for m in merges:
            m.prepare(values[m.begin : m.end], _weights(e[m.split - 1], ends[1, m.begin : m.split], ends[0, m.split : m.end]))
        _solve_roots(spark, merges)
        for m in merges:
            values[m.begin : m.end] = m.finish()
        if level is not tree[-1]:
            _merged_ends(spark, merges, ends)
    return values


def divide_and_conquer(spark: SparkSession, d: np.ndarray, e: np.ndarray, nb: int, leaf: int | None = None) -> tuple[np.ndarray, TiledMatrix]:
    """Ascending eigenvalues of the tridiagonal matrix and its eigenvectors in square tiles of nb."""
    n, e = len(d), np.asarray(e, float)
    empty = TiledMatrix(spark.createDataFrame([], TILE), n, n, nb, nb)
    if not n:
        return np.array(d, float), empty
    d, edges, tree = _cut(d, e, nb, leaf)
    with Scratch(spark) as scratch:
        first = scratch.stored(_leaves(spark, d, e, edges, nb))
        values = d.copy()
        for batch in first.filter("ti = -1").toArrow().to_batches():
            for _, at, x in unpack(batch):
                values[edges[at] : edges[at + 1]] = x[:, 0]
        q = first.filter("ti >= 0")
        for level in tree:
            merges = [Merge(edges[b], edges[s], edges[x], 2 * abs(e[edges[s] - 1])) for b, s, x in level]
            cut = _rows_at_cuts(q, {r for m in merges for r in (m.split - 1, m.split)}, nb, n)
            for m in merges:
                m.prepare(values[m.begin : m.end], _weights(e[m.split - 1], cut[m.split - 1][m.begin : m.split], cut[m.split][m.split : m.end]))
            solve_secular(spark, merges)
            for m in merges:
                values[m.begin : m.end] = m.finish()
            q = scratch.stored(_merged(spark, q, merges, nb, n))
            scratch.drop_before()
        q = stored(q, "eigenvectors")
    return values, replace(empty, tiles=q)


def _merged(spark: SparkSession, q: DataFrame, merges: list[Merge], nb: int, n: int) -> DataFrame:
    """Tiles of the merged eigenvectors; those of parts that wait for a later level stay as they are."""
    sent = spark.sparkContext.broadcast(merges)

    def of(ti: int) -> Merge:
        return next(m for m in sent.value if m.begin <= ti * nb < m.end)

    def product(ti: int, strip: np.ndarray) -> Iterator[Tile]:
        m = of(ti)
        yield from ((ti, m.begin // nb + k, x) for k, x in enumerate(m.strip(strip, ti * nb < m.split, nb)))

    inside = " or ".join(f"ti >= {m.begin // nb} and ti < {-(-m.end // nb)}" for m in merges)
    done = _strips(q.filter(inside), _parts(spark, -(-n // nb)), lambda ti: (of(ti).begin, of(ti).end), nb, product, False)
    return done.unionAll(q.filter(f"not ({inside})"))


def largest_residual(d: np.ndarray, e: np.ndarray, values: np.ndarray, z: TiledMatrix) -> float:
    """max |T Z - Z diag(values)| for the tridiagonal T: a column's tiles pass by in their order, and a task holds three of them."""
    d, e, values = (np.asarray(x, float) for x in (d, e, values))
    require(z.m == len(d) == len(e) + 1 and z.n == len(values), "sizes of the matrix and its eigenpairs differ")
    require(d.nbytes + e.nbytes + values.nbytes <= BROADCAST_BYTES, "the order is too large for a broadcast of the diagonals")
    sent = z.spark.sparkContext.broadcast((d, np.concatenate(([0.0], e, [0.0])), values))
    m, n, mb, nb, count, kind = z.m, z.n, z.mb, z.nb, z.rows.tiles, z.numpy_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole() -> Iterator[Tile]:
            """All tiles of the columns that have any, zeros too."""
            column, following = None, 0
            for batch in batches:
                for ti, tj, x in unpack(batch):
                    if tj != column:
                        if column is not None:
                            yield from ((k, column, nothing(k, column)) for k in range(following, count))
                        column, following = tj, 0
                    yield from ((k, column, nothing(k, column)) for k in range(following, ti))
                    # A view would keep its batch.
                    yield ti, tj, np.array(x)
                    following = ti + 1
            if column is not None:
                yield from ((k, column, nothing(k, column)) for k in range(following, count))

        def nothing(ti: int, tj: int) -> np.ndarray:
            return np.zeros((min(mb, m - ti * mb), min(nb, n - tj * nb)), kind)

        def of(above: np.ndarray | None, tile: Tile, below: np.ndarray | None) -> float:
            ti, tj, x = tile
            d, e, values = sent.value
            lo, hi = ti * mb, ti * mb + len(x)
            out = d[lo:hi, None] * x - x * values[tj * nb : tj * nb + x.shape[1]]
            out[1:] += e[lo + 1 : hi, None] * x[:-1]
            out[:-1] += e[lo + 1 : hi, None] * x[1:]
            out[0] += 0 if above is None else e[lo] * above
            out[-1] += 0 if below is None else e[hi] * below
            return float(np.abs(out).max())

        worst, above, tile = 0.0, None, None
        for now in whole():
            if tile is not None:
                same = now[1] == tile[1]
                worst = np.maximum(worst, of(above, tile, now[2][0] if same else None))
                above = tile[2][-1].copy() if same else None
            tile = now
        if tile is not None:
            yield pa.RecordBatch.from_arrays([pa.array([float(np.maximum(worst, of(above, tile, None)))])], ["worst"])

    found = z.tiles.repartition(_parts(z.spark, z.columns.tiles), "tj").sortWithinPartitions("tj", "ti").mapInArrow(run, "worst double")
    return found.agg(F.max("worst")).first()[0] or 0.0


def apart_from_orthonormal(z: TiledMatrix, held: int | None = None) -> float:
    """max |Zᴴ Z - 1|: each pair of groups of columns meets in a task, a strip of rows at a time; ``held`` numbers of products at most, or one tile's.

    The product is Hermitian, so a pair is looked at once.
    """
    count, mb, nb = z.columns.tiles, z.mb, z.nb
    if not count:
        return 0.0
    wide, least = max(1, int((held or PRODUCTS_HELD) ** 0.5) // nb), 1
    while least * (least + 1) // 2 < z.spark.sparkContext.defaultParallelism:
        least += 1
    wide = min(wide, -(-count // min(count, least)))
    groups, n, kind = -(-count // wide), z.n, z.numpy_type
    width = lambda g: min(n, (g + 1) * wide * nb) - g * wide * nb
    dealt = z.tiles.withColumn("mine", F.expr(f"tj div {wide}")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    dealt = dealt.withColumn("pair", F.expr(f"greatest(mine, other) * {groups} + least(mine, other)")).drop("mine", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row, filled, sums, strips, worst = None, None, False, None, None, 0.0

        def add() -> None:
            left, right = strips[0][:rows], strips[-1][:rows]
            for j in range(0, sums.shape[1], 512):
                sums[:, j : j + 512] += left.conj().T @ right[:, j : j + 512]
            for strip in strips:
                strip[:] = 0

        def largest() -> float:
            if now // groups == now % groups:
                sums[np.diag_indices(len(sums))] -= 1
            return float(max(np.abs(sums[:, j : j + 512]).max() for j in range(0, sums.shape[1], 512)))

        rows = 0
        for batch in batches:
            for (ti, tj, x), pair in zip(unpack(batch), batch.column(6).to_pylist(), strict=True):
                if (pair, ti) != (now, row) and filled:
                    add()
                    filled = False
                if pair != now:
                    if now is not None:
                        worst = np.maximum(worst, largest())
                    now, sides = pair, sorted({pair // groups, pair % groups}, reverse=True)
                    sums = strips = None
                    sums = np.zeros((width(sides[0]), width(sides[-1])), kind)
                    strips = [np.zeros((mb, width(g)), kind) for g in sides]
                at = sides.index(tj // wide)
                left = (tj - sides[at] * wide) * nb
                strips[at][: len(x), left : left + x.shape[1]] = x
                row, rows, filled = ti, len(x), True
        if now is not None:
            add()
            yield pa.RecordBatch.from_arrays([pa.array([float(np.maximum(worst, largest()))])], ["worst"])

    found = dealt.repartition(max(1, groups * (groups + 1) // 2), "pair").sortWithinPartitions("pair", "ti").mapInArrow(run, "worst double")
    # A column without a tile is one of zeros.
    missing = z.tiles.select("tj").distinct().count() < count
    return max(found.agg(F.max("worst")).first()[0] or 0.0, 1.0 if missing else 0.0)
