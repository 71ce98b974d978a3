"""Operator 12: embedding whitening from a compensated covariance.

Entries become integers x = floor(1024 c) + 100000. One pass over the fit list gives n and the sums S of each dimension, exactly. A
second pass centres each vector on S / n as a pair of doubles (value and rounding error), multiplies it by itself without
losing the products' rounding errors (Dekker's splitting) and adds the products up in double-double with error-free
sums. Each task hands on one row of high and of low parts for each dimension; a shuffle by dimension merges those of all
tasks, high and low parts together. The covariance (as many numbers as a vector has, squared) is reduced to a
tridiagonal matrix and solved by divide and conquer. A last pass projects the centred vectors.

Defined results: rows whose vector is null, has null or non-finite entries, or isn't as long as the longest such vector, take
no part; vectors of length 0 don't either; repeated rows count as often as they are there; x is cut off at +-2^31; ``deviation`` is null where it
doesn't fit a long; components whose eigenvalue isn't above ``d x 2^-52`` of the largest have no direction to scale: their ``whitened`` is null and they
don't count in ``identity_error`` (which is null if none is left); an empty fit list gives an empty result; columns other than
the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import apply_panels, reduction_to_band, tridiagonal_eigensolver

SCALE, SHIFT = 1024.0, 100000
COMPONENTS = 8
#: Numbers of a block of outer products that are summed at once.
BLOCK = 1 << 16
#: x stays in this range, so that sums and n x - S are exact.
REACH = 1 << 31

Pair = tuple[np.ndarray, np.ndarray]


def split(a: np.ndarray) -> Pair:
    """Two halves of 26 bits (Dekker)."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    high, error = two_sum(x[0], y[0])
    low, rest = two_sum(x[1], y[1])
    error = error + low
    s = high + error
    error = rest + (error - (s - high))
    high = s + error
    return high, error - (high - s)


def divided(high: np.ndarray, low: np.ndarray, n: int) -> Pair:
    """A double-double over an integer."""
    value = high / n
    (vh, vl), (nh, nl) = split(value), split(np.float64(n))
    product = value * n
    error = ((vh * nh - product) + vh * nl + vl * nh) + vl * nl
    rest = ((high - product) - error + low) / n
    s = value + rest
    return s, rest - (s - value)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> Pair:
    """x - S / n as double-doubles, of integers."""
    top = n * x - sums  # exact
    whole = top.astype(np.float64)
    return divided(whole, (top - whole.astype(np.int64)).astype(np.float64), n)


def outer_products(y: Pair) -> Pair:
    """The sum of all y yT, in double-double."""
    high, low = y
    d = high.shape[1]
    at_once = max(1, BLOCK // max(1, d * d))
    total = np.zeros((d, d)), np.zeros((d, d))
    big, small = split(high)
    for k in range(0, len(high), at_once):
        a, l, h, s = (v[k : k + at_once] for v in (high, low, big, small))
        times = lambda u, v: u[:, :, None] * v[:, None, :]
        p = times(a, a)
        cross = times(h, s)
        error = ((times(h, h) - p) + cross + cross.transpose(0, 2, 1)) + times(s, s)
        both = times(a, l)
        error += both + both.transpose(0, 2, 1)
        high_part = p + error
        block = high_part, error - (high_part - p)
        while len(block[0]) > 1:
            half = len(block[0]) // 2
            added = add_pairs(tuple(v[:half] for v in block), tuple(v[half : 2 * half] for v in block))
            block = tuple(np.concatenate((v, w[2 * half :])) for v, w in zip(added, block, strict=True))
        total = add_pairs(total, (block[0][0], block[1][0]))
    return total


def _vectors(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and integers of the rows that take part; they have the size that is given, or the longest of the batch."""
    column = column.cast(pa.large_list(pa.float64()))
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = np.asarray(column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False), np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    ends = np.cumsum(lengths)
    good = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if size is None:
        size = int(lengths[good].max(initial=0))
    at = np.flatnonzero(good & (lengths == size))
    if not len(at):
        return at, np.zeros((0, size), np.int64)
    chosen = values[(ends[at] - size)[:, None] + np.arange(size)]
    return at, np.clip(np.floor(SCALE * chosen) + SHIFT, -REACH, REACH).astype(np.int64)


@dataclass
class Whitening:
    """n, the sums of each dimension, the directions (columns) with their eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        """Components that have a variance to scale by."""
        return self.values > len(self.sums) * 2.0**-52 * max(self.values.max(initial=0), 0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integer vectors; nan in components without variance."""
        high, low = centred(x, self.n, self.sums)
        usable = self.usable()
        scale = np.where(usable, 1 / np.sqrt(np.where(usable, self.values, 1)), np.nan)
        return (high @ self.directions + low @ self.directions) * scale


def _sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number and sums of the vectors of the greatest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n, total = 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            x = _vectors(batch.column(0))[1]
            if x.shape[1] > size:
                size, n, total = x.shape[1], 0, np.zeros(x.shape[1], np.int64)
            if len(x) and x.shape[1] == size:
                n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()), pa.array(total)], ["size", "at", "n", "s"])

    parts = vectors.mapInArrow(run, "size int, at int, n long, s long").groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    # As many rows as the vectors have dimensions, for each of their lengths.
    longest = parts.agg(F.max("size")).first()[0]
    if not longest:
        return 0, np.zeros(0, np.int64)
    rows = sorted(parts.filter(F.col("size") == longest).collect(), key=lambda r: r["at"])
    return rows[0]["n"], np.array([int(r["s"]) for r in rows], np.int64)


def _double_double_rows(frame: DataFrame) -> list:
    """Rows (at, high, low): the sums of all tasks' rows of each dimension, merged where the dimension's rows meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: int, total: Pair) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), *(pa.array([v], pa.list_(pa.float64())) for v in total)], ["at", "high", "low"])

        key, total = None, None
        for batch in batches:
            high, low = batch.column(1), batch.column(2)
            for k, at in enumerate(batch.column(0).to_pylist()):
                row = high[k].values.to_numpy(), low[k].values.to_numpy()
                if at == key:
                    total = add_pairs(total, row)
                else:
                    if key is not None:
                        yield out(key, total)
                    key, total = at, row
        if key is not None:
            yield out(key, total)

    merged = frame.repartition("at").sortWithinPartitions("at").mapInArrow(run, "at int, high array<double>, low array<double>")
    return sorted(merged.collect(), key=lambda r: r["at"])


def covariance(vectors: DataFrame, n: int, sums: np.ndarray) -> Pair:
    """Sum of the centred outer products over n, as a double-double."""
    size = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size)), np.zeros((size, size))
        for batch in batches:
            _, x = _vectors(batch.column(0), size)
            total = add_pairs(total, outer_products(centred(x, n, sums)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), *(pa.array(list(v), pa.list_(pa.float64())) for v in total)], ["at", "high", "low"])

    rows = _double_double_rows(vectors.mapInArrow(run, "at int, high array<double>, low array<double>"))
    high, low = (np.array([r[k] for r in rows], float) for k in ("high", "low"))
    return divided(high, low, n)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the fit list (one column of vectors); None if it is empty."""
    n, sums = _sums(vectors)
    if not n:
        return None
    v = covariance(vectors, n, sums)[0]
    banded, panels = reduction_to_band((v + v.T) / 2, 1)
    values, directions = tridiagonal_eigensolver(np.diag(banded).copy(), np.diag(banded, -1).copy())
    directions = apply_panels(panels, directions)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, sums, directions[:, order], values[order], float(np.trace(v)))


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance less the identity; tasks' moments meet by Chan's formula."""
    usable = np.flatnonzero(model.usable())
    if not len(usable):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0, np.zeros(len(usable)), np.zeros((len(usable), len(usable)))
        for batch in batches:
            w = model.project(_vectors(batch.column(0), len(model.sums))[1])[:, usable]
            if len(w):
                mean = w.mean(axis=0)
                state = _joined(state, (len(w), mean, (w - mean).T @ (w - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([state[0]]), pa.array([state[1]], pa.list_(pa.float64())), pa.array([state[2].ravel()], pa.list_(pa.float64()))], ["n", "mean", "moment"])

    state = 0, np.zeros(len(usable)), np.zeros((len(usable), len(usable)))
    # One row of at most COMPONENTS^2 + COMPONENTS numbers for each task.
    for r in vectors.mapInArrow(run, "n long, mean array<double>, moment array<double>").toLocalIterator():
        state = _joined(state, (r["n"], np.array(r["mean"]), np.array(r["moment"]).reshape(len(usable), -1)))
    return float(np.abs(state[2] / model.n - np.eye(len(usable))).max())


def _joined(x: tuple, y: tuple) -> tuple:
    n = x[0] + y[0]
    if not n:
        return x
    gap = y[1] - x[1]
    return n, x[1] + gap * (y[0] / n), x[2] + y[2] + np.outer(gap, gap) * (x[0] * y[0] / n)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each component."""
    rows = rows.select(id_col, F.col(vector_col).cast("array<double>").alias("vector"))
    id_type = dict(rows.dtypes)[id_col]
    schema = f"{id_col} {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = rows.select("vector")
    model = fit(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model)
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.values)
        explained = model.values / model.trace if model.trace > 0 else np.zeros(count)
        for batch in batches:
            at, x = _vectors(batch.column(1), len(model.sums))
            if not len(at):
                continue
            top = model.n * x - model.sums
            with np.errstate(over="ignore"):
                exact = (top * top).sum(axis=1)
            fits = (top.astype(np.float64) ** 2).sum(axis=1) < 2.0**63 * (1 - 1e-12)
            w = model.project(x)
            repeat = lambda v: np.repeat(v, count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(repeat(at))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * count, model.n)),
                    pa.array(repeat(exact), mask=~repeat(fits)),
                    pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                    pa.array(np.tile(explained, len(at))),
                    pa.array([error] * (len(at) * count), pa.float64()),
                ],
                names,
            )

    return rows.mapInArrow(run, schema)
