"""Matrices from functions and seeded random matrices that don't depend on how tiles are dealt."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import SparkSession

from ..matrix import TiledMatrix


def zeros(spark: SparkSession, m: int, n: int, mb: int, nb: int, dtype: str = "d") -> TiledMatrix:
    return replace(TiledMatrix.generate(spark, 0, 0, mb, nb, lambda i, j: i, dtype), m=m, n=n)


def from_function(spark: SparkSession, m: int, n: int, mb: int, nb: int, f: Callable, op: str = "N", dtype: str = "d") -> TiledMatrix:
    """f(i, j) of index arrays, or its (conjugate) transpose."""
    g = f if op == "N" else (lambda i, j: f(j, i)) if op == "T" else (lambda i, j: np.conj(f(j, i)))
    return TiledMatrix.generate(spark, m, n, mb, nb, g, dtype)


def identity(spark: SparkSession, n: int, nb: int, dtype: str = "d") -> TiledMatrix:
    return TiledMatrix.generate(spark, n, n, nb, nb, lambda i, j: (i == j) * 1.0, dtype, keep="ti = tj")


def _draw(i: np.ndarray, j: np.ndarray, columns: int, complex_: bool) -> np.ndarray:
    """Uniform on [-1, 1], or in the unit disc, seeded by the tile's first element."""
    rng = np.random.default_rng(int(i.min()) * columns + int(j.min()))
    shape = (i.size, j.size)
    if not complex_:
        return rng.uniform(-1, 1, shape)
    squares, turns, out = rng.random(shape).ravel(), rng.random(shape).ravel(), np.empty(i.size * j.size, complex)
    for k in range(0, out.size, IN_CACHE):
        some = slice(k, k + IN_CACHE)
        _in_disc(squares[some], turns[some], out[some])
    return out.reshape(shape)


#: Elements that are drawn at once, so that they stay in a core's cache.
IN_CACHE = 1 << 14
#: Points of the unit circle; an angle is one of them and a rest.
_CIRCLE = np.exp(2j * np.pi * np.arange(1024) / 1024)


def _in_disc(squares: np.ndarray, turns: np.ndarray, out: np.ndarray) -> None:
    """sqrt(squares) exp(2 pi i turns), to a few units in the last place: the rest's sine and cosine are short series."""
    size, rest = np.sqrt(squares), turns * len(_CIRCLE)
    place = rest.astype(np.int32)
    rest -= place
    rest *= 2 * np.pi / len(_CIRCLE)
    square = rest * rest
    sine = square * (1 / 120)
    sine -= 1 / 6
    sine *= square
    sine += 1
    sine *= rest
    cosine = square * (-1 / 720)
    cosine += 1 / 24
    cosine *= square
    cosine -= 0.5
    cosine *= square
    cosine += 1
    np.multiply(cosine, size, out=out.real)
    np.multiply(sine, size, out=out.imag)
    out *= _CIRCLE.take(place)


def random(spark: SparkSession, m: int, n: int, mb: int, nb: int, dtype: str = "d") -> TiledMatrix:
    return TiledMatrix.generate(spark, m, n, mb, nb, lambda i, j: _draw(i, j, n, dtype in "cz"), dtype)


def random_hermitian(spark: SparkSession, n: int, nb: int, offset: float = 0, dtype: str = "d", band: int | None = None) -> TiledMatrix:
    """A tile and its mirror are drawn once, from the lower one's seed; the diagonal is real, plus an offset."""

    def f(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a = _draw(i, j, n, dtype in "cz")
        if int(i.min()) == int(j.min()):
            low = np.tril(a, -1)
            a = low + low.conj().T + np.diag(np.diag(a).real + offset)
        return np.where(np.abs(i - j) <= band, a, 0) if band is not None else a

    # A band's tiles of zeros aren't made.
    return TiledMatrix.generate(spark, n, n, nb, nb, f, dtype, keep="true" if band is None else f"abs(ti - tj) * {nb} < {band + nb}", hermitian=True)


def random_positive_definite(spark: SparkSession, n: int, nb: int, dtype: str = "d") -> TiledMatrix:
    return random_hermitian(spark, n, nb, 2 * n, dtype)


def random_non_zero_diagonal(spark: SparkSession, n: int, nb: int, dtype: str = "d") -> TiledMatrix:
    """Moduli on the diagonal lie in [0.1, 1]."""

    def f(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a = _draw(i, j, n, dtype in "cz")
        size = np.abs(a)
        unit = np.where(size > 0, a / np.where(size > 0, size, 1), 1)
        return np.where(i == j, unit * (0.1 + 0.9 * np.minimum(size, 1)), a)

    return TiledMatrix.generate(spark, n, n, nb, nb, f, dtype)
