"""Stages of the Hermitian eigensolver on numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np

from .kernels import full, householder_panel, larfg, larft


def reduction_to_band(a: np.ndarray, band: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The band matrix Qᴴ A Q (full storage) and the panels (first row, V, taus) of Q."""
    a, panels = a.copy(), []
    for k in range(0, max(0, len(a) - band - 1), band):
        v, taus, r = householder_panel(a[k + band :, k : k + band])
        t = larft(v, taus)
        a[k + band :, k : k + band] = 0
        a[k + band : k + band + len(r), k : k + band] = r
        a[k : k + band, k + band :] = a[k + band :, k : k + band].conj().T
        rest = a[k + band :, k + band :]
        w = v @ t
        x = rest @ w
        x = x - 0.5 * v @ (w.conj().T @ x)
        rest -= x @ v.conj().T + v @ x.conj().T
        panels.append((k + band, v, taus))
    return a, panels


def apply_panels(panels: list[tuple[int, np.ndarray, np.ndarray]], c: np.ndarray) -> np.ndarray:
    """Q C, the last panel first."""
    c = c.astype(np.result_type(c, *(v for _, v, _ in panels)) if panels else c.dtype)
    for first, v, taus in reversed(panels):
        c[first:] -= v @ (larft(v, taus) @ (v.conj().T @ c[first:]))
    return c


Reflector = tuple[int, np.ndarray, complex]


def band_storage(n: int, band: int, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The band's elements row by row, each row shifted so that its diagonal element is in the middle.

    There is room for the fill-in of the bulge chasing: n x (4 band + 1) numbers.
    """
    out = np.zeros((n, 4 * band + 1), values.dtype)
    near = np.abs(i - j) <= band
    out[i[near], (j - i)[near] + 2 * band] = values[near]
    return out


def band_to_tridiagonal(a: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, list[Reflector]]:
    """Bulge chasing of a matrix in full storage."""
    i, j = np.indices(a.shape)
    return chase(band_storage(len(a), band, i.ravel(), j.ravel(), a.ravel()), band)


def chase(stored: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, list[Reflector]]:
    """Bulge chasing: diagonal, off-diagonal and the reflectors in the order of their use."""
    n = len(stored)
    every = lambda sweep: (0, n)
    done = [(row, v, tau) for _, _, row, v, tau in chase_part(stored, 0, n, band, range(sweeps(n, np.iscomplexobj(stored))), every)]
    middle = 2 * band
    below = stored[1:, middle - 1] if band else stored[1:, 0] * 0
    return stored[:, middle].real.copy(), below.real.copy(), done


def sweeps(n: int, complex_: bool) -> int:
    """Complex matrices need a last reflector of one element, which makes the last off-diagonal element real."""
    return max(0, n - 1 if complex_ else n - 2)


def chase_part(stored: np.ndarray, first: int, n: int, band: int, part: range, bounds: Callable[[int], tuple[int, int]]) -> Iterator[tuple[int, int, int, np.ndarray, complex]]:
    """Steps of some sweeps whose reflectors begin in bounds(sweep), on rows of the band from ``first`` on, in place.

    A sweep clears one column below its first subdiagonal and drives the fill-in off the matrix. Gives (sweep, step, row, v, tau).
    """
    middle, flat, size = 2 * band, stored.ravel(), stored.itemsize

    def block(top: int, end: int, lo: int, hi: int) -> np.ndarray:
        # A row further down, an element lies one place further left.
        return np.lib.stride_tricks.as_strided(flat[(top - first) * (2 * middle + 1) + lo - top + middle :], (end - top, hi - lo), (2 * middle * size, size))

    for sweep in part:
        least, most = bounds(sweep)
        step = max(0, -(-(least - sweep - 1) // band)) if band else 0
        row = sweep + 1 + step * band
        while row < min(n, most):
            column = row - band if step else sweep
            end = min(row + band, n)
            v, tau, _ = larfg(block(row, end, column, column + 1)[:, 0])
            if tau != 0:
                lo, hi = column, min(end + band, n)
                rows, columns = block(row, end, lo, hi), block(lo, hi, row, end)
                rows -= np.conj(tau) * np.outer(v, v.conj() @ rows)
                columns -= tau * np.outer(columns @ v, v.conj())
                yield sweep, step, row, v, tau
            step, row = step + 1, row + band


def apply_reflectors(reflectors: list[Reflector], e: np.ndarray) -> np.ndarray:
    """Q E for Q = H0 H1 ..."""
    if not reflectors:
        return e.copy()
    e = e.astype(np.result_type(e, reflectors[0][1]))
    for row, v, tau in reversed(reflectors):
        part = e[row : row + len(v)]
        part -= tau * np.outer(v, v.conj() @ part)
    return e


def merge_order(leaves: int) -> list[tuple[int, int, int]]:
    """(begin, split, end) of the merges of leaves, children before parents."""

    def below(begin: int, end: int) -> list[tuple[int, int, int]]:
        if end - begin < 2:
            return []
        split = -(-(begin + end) // 2)
        return [*below(begin, split), *below(split, end), (begin, split, end)]

    return below(0, leaves)


#: Numbers of a block of differences of poles and roots, so that its passes stay in a core's cache.
IN_CACHE = 1 << 16
#: Points of an interpolation. Poles further from an interval than its length give sums that are smooth on it: the error falls by 5.8 for each point.
POINTS = 24
#: Roots of an interval of their own, and poles whose weights are made together.
ROOTS, WEIGHTS = 512, 2048
_ANGLES = (2 * np.arange(POINTS) + 1) * np.pi / (2 * POINTS)
_NODES, _SIGNS = -np.cos(_ANGLES), np.sin(_ANGLES) * (-1.0) ** np.arange(POINTS)


class Near(NamedTuple):
    """Places lo..hi of ascending poles, and the poles first..end that aren't far from the interval that begins at d[lo]."""

    lo: int
    hi: int
    first: int
    end: int
    length: float


def intervals(d: np.ndarray, top: float, lo: int, hi: int, size: int) -> Iterator[Near]:
    """Intervals of at most ``size`` places each, cut further while many poles are near one; ``top`` is above all poles and roots."""
    k = len(d)
    if k <= 4 * size:
        yield from (Near(at, min(at + size, hi), 0, k, 0.0) for at in range(lo, hi, size))
        return
    waiting = [(lo, hi)]
    while waiting:
        lo, hi = waiting.pop()
        if hi <= lo:
            continue
        if hi == k and hi - lo > 1:  # the last interval may be long
            waiting += [(k - 1, k), (lo, k - 1)]
            continue
        end = d[hi] if hi < k else top
        length = end - d[lo]
        # A root lies between its pole and the next, so the pole before a near one is near, too.
        first, last = max(0, int(np.searchsorted(d, d[lo] - length)) - 1), int(np.searchsorted(d, end + length, "right"))
        if hi - lo > 1 and (hi - lo > size or last - first > 4 * (size + hi - lo)):
            waiting += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        else:
            yield Near(lo, hi, first, last, length)


def far_sums(d: np.ndarray, near: Near, part: slice, f: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
    """Sums over far poles at the interpolation's points: f(differences of some poles and the points, which poles) gives rows by point."""
    at, total = (_NODES + 1) * (near.length / 2), None
    for k in range(part.start, part.stop, IN_CACHE // POINTS):
        some = slice(k, min(part.stop, k + IN_CACHE // POINTS))
        now = f((d[some] - d[near.lo])[None, :] - at[:, None], some)
        total = now if total is None else total + now
    return total


def interpolation(near: Near, x: np.ndarray) -> np.ndarray:
    """Factors of the values at the points for the distances x from d[lo]."""
    apart = (x * (2 / near.length) - 1)[:, None] - _NODES[None, :]
    hit = apart == 0
    factors = np.where(hit.any(axis=1, keepdims=True), hit, _SIGNS / np.where(hit, 1, apart))
    return factors / factors.sum(axis=1, keepdims=True)


def secular_range(d: np.ndarray, z: np.ndarray, rho: float, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Roots lo..hi of 1 + rho Σ z²/(d - x) = 0 for ascending d and rho > 0: the nearer pole's index and the distance from it.

    Root j lies between poles j and j + 1. Each step fits one pole on either side to the value and the slope of the sums left
    and right of the root, and solves that for the next point; one outside of the bracket gives way to the bracket's middle.
    The distance to the pole keeps its relative precision, so the differences d_i - x do too. Of many poles, those far from an
    interval of roots are summed at a few points of it, once.
    """
    squares = rho * z**2
    found = [_roots(d, squares, near) for near in intervals(d, d[-1] + squares.sum(), lo, hi, ROOTS)] if hi > lo else []
    pole, x = zip(*found, strict=True) if found else ([np.zeros(0, int)], [np.zeros(0)])
    return np.concatenate(pole), np.concatenate(x)


def _roots(d: np.ndarray, squares: np.ndarray, where: Near) -> tuple[np.ndarray, np.ndarray]:
    lo, hi, first, end, _ = where
    j, k = np.arange(lo, hi), len(d)
    top = d[-1] + squares.sum()
    right = np.minimum(j + 1, k - 1)
    upper = np.where(j + 1 < k, d[right], top)
    # Poles before lo are left of all these roots, poles from hi on right of them.
    left_side = np.arange(lo, hi)[None, :] <= j[:, None]
    at_once = max(1, IN_CACHE // max(end - first, 1))
    close, weights = d[first:end], squares[first:end]
    inner, outer = lo - first, hi - first

    def sums(gap: np.ndarray, some: slice) -> np.ndarray:
        np.reciprocal(gap, out=gap)
        value = gap @ squares[some]
        gap *= gap
        return np.stack((value, gap @ squares[some]), axis=1)

    distant = [None if part.start >= part.stop else far_sums(d, where, part, sums) for part in (slice(0, first), slice(end, k))]

    def parts(origin: np.ndarray, x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums and slopes of the poles left and right of the roots, a few roots at a time."""
        out = np.empty((4, len(rows)))
        for begin in range(0, len(rows), at_once):
            some = slice(begin, begin + at_once)
            gap = close[None, :] - origin[some, None]
            gap -= x[some, None]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                value = weights / gap
                slope = np.divide(value, gap, out=gap)
            mine = left_side[rows[some]]
            for at, v in ((0, value), (1, slope)):
                out[at, some] = v[:, :inner].sum(axis=1) + np.where(mine, v[:, inner:outer], 0).sum(axis=1)
                out[at + 2, some] = np.where(mine, 0, v[:, inner:outer]).sum(axis=1) + v[:, outer:].sum(axis=1)
        if any(f is not None for f in distant):
            factors = interpolation(where, (origin - d[lo]) + x)
            for at, f in zip((0, 2), distant, strict=True):
                if f is not None:
                    out[at : at + 2] += (factors @ f).T
        return tuple(out)

    half = (upper - d[j]) / 2
    below, _, above, _ = parts(d[j], half, j - lo)
    to_left = (1 + below + above >= 0) | (j == k - 1)
    pole = np.where(to_left, j, right)
    origin = d[pole]
    low = np.where(to_left, 0.0, -half)
    high = np.where(to_left, np.where(j == k - 1, upper - d[j], half), 0.0)
    x = (low + high) / 2
    live, eps = np.arange(len(j)), np.finfo(float).eps
    for step in range(200):
        below, below_slope, above, above_slope = parts(origin[live], x[live], live)
        f, here = 1 + below + above, x[live]
        low[live], high[live] = np.where(f < 0, here, low[live]), np.where(f < 0, high[live], here)
        error = eps * (1 + 8 * (np.abs(below) + np.abs(above)) + np.abs(here) * (below_slope + above_slope))
        width = high[live] - low[live]
        open_ = (np.abs(f) > error) & (width > 2 * eps * np.abs(here))
        live, f, here = live[open_], f[open_], here[open_]
        if not len(live):
            break
        below_slope, above_slope = below_slope[open_], above_slope[open_]
        near = (d[j[live]] - origin[live]) - here
        far = (d[right[live]] - origin[live]) - here
        last = j[live] == k - 1
        c = f - near * below_slope - np.where(last, 0, far * above_slope)
        a, b = (near + far) * f - near * far * (below_slope + above_slope), near * far * f
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move = np.where(last, near + near * near * below_slope / c, move)
        following = here + move
        lo_, hi_ = low[live], high[live]
        inside = np.isfinite(following) & (following > lo_) & (following < hi_)
        # Where one end is the pole itself, the middle is a geometric one.
        small, large = np.minimum(np.abs(lo_), np.abs(hi_)), np.maximum(np.abs(lo_), np.abs(hi_))
        middle = np.where(small > 0, np.sqrt(small * large), large * (0.5 if step < 8 else 1e-3)) * np.where(to_left[live], 1.0, -1.0)
        x[live] = np.where(inside & (step < 60), following, np.where((middle > lo_) & (middle < hi_), middle, (lo_ + hi_) / 2))
    return pole, x


def range_of_weight_logs(d: np.ndarray, rho: float, pole: np.ndarray, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The sums of ``weight_logs`` over all roots, for the poles lo..hi: far roots and their poles are summed at a few points."""
    k, out = len(d), np.zeros(hi - lo)
    moved = (d[pole] - d) + x  # from a root's left pole to the root
    for near in intervals(d, d[-1] + moved[-1], lo, hi, WEIGHTS):
        first, end, mine = near.first, near.end, slice(near.lo - lo, near.hi - lo)
        places = np.arange(near.lo, near.hi)
        at_once = max(1, IN_CACHE // (end - first))
        for begin in range(0, len(places), at_once):
            some = places[begin : begin + at_once]
            gap = (d[pole[first:end]][None, :] - d[some, None]) + x[None, first:end]
            apart = d[None, first:end] - d[some, None]
            apart[some - some[0], some - first] = rho
            gap /= apart
            out[some - lo] = np.log(np.abs(gap, out=gap), out=gap).sum(axis=1)

        def logs(gap: np.ndarray, some: slice) -> np.ndarray:
            return np.log1p(np.divide(moved[some], gap, out=gap), out=gap).sum(axis=1, keepdims=True)

        far = [far_sums(d, near, part, logs) for part in (slice(0, first), slice(end, k)) if part.start < part.stop]
        if far:
            out[mine] += (interpolation(near, d[places] - d[near.lo]) @ sum(far))[:, 0]
    return out


def range_of_rows(d: np.ndarray, weight: np.ndarray, rows: np.ndarray, pole: np.ndarray, x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Rows times the unit eigenvectors of the roots lo..hi, whose elements are in proportion to weight / (d - root)."""
    k, out = len(d), np.zeros((len(rows), hi - lo))
    weighted, squares = (rows * weight).T.copy(), weight * weight
    for near in intervals(d, d[pole[-1]] + x[-1], lo, hi, WEIGHTS):
        first, end, mine = near.first, near.end, slice(near.lo - lo, near.hi - lo)
        total = np.zeros((near.hi - near.lo, len(rows) + 1))

        def sums(gap: np.ndarray, some: slice) -> np.ndarray:
            np.reciprocal(gap, out=gap)
            value = gap @ weighted[some]
            gap *= gap
            return np.column_stack((value, gap @ squares[some]))

        at_once = max(1, IN_CACHE // (end - first))
        for begin in range(near.lo, near.hi, at_once):
            some = slice(begin, min(near.hi, begin + at_once))
            total[some.start - near.lo : some.stop - near.lo] = sums((d[None, first:end] - d[pole[some], None]) - x[some, None], slice(first, end))
        far = [far_sums(d, near, part, sums) for part in (slice(0, first), slice(end, k)) if part.start < part.stop]
        if far:
            total += interpolation(near, (d[pole[near.lo : near.hi]] - d[near.lo]) + x[near.lo : near.hi]) @ sum(far)
        out[:, mine] = (total[:, :-1] / np.sqrt(total[:, -1:])).T
    return out


def weight_logs(d: np.ndarray, rho: float, lo: int, pole: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each pole i, the log of the roots' share in its weight: Π |root_j - d_i| / |d_j - d_i| (without the divisor at j = i)."""
    total, at_once = np.zeros(len(d)), max(1, IN_CACHE // max(len(d), 1))
    for b in range(0, len(pole), at_once):
        some = slice(b, b + at_once)
        roots = np.arange(lo, lo + len(pole))[some]
        gap = d[None, :] - d[pole[some], None]
        gap -= x[some, None]
        apart = d[None, :] - d[roots, None]
        apart[roots - roots[0], roots] = rho
        gap /= apart
        total += np.log(np.abs(gap, out=gap), out=gap).sum(axis=0)
    return total


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """All roots: the differences' matrix (d_i - x_j), and the roots."""
    pole, x = secular_range(d, z, rho, 0, len(d))
    return (d[:, None] - d[pole][None, :]) - x[None, :], d[pole] + x


class Deflated(NamedTuple):
    """Poles and weights in ascending order after deflation; ``rotations`` are (p, i, c, s) on ascending places."""

    order: np.ndarray
    d: np.ndarray
    z: np.ndarray
    live: np.ndarray
    rotations: list[tuple[int, int, float, float]]


def deflate(d: np.ndarray, z: np.ndarray, rho: float) -> Deflated:
    """Poles without weight, and all but the last of equal poles, keep their eigenpairs: rotations take their weight away."""
    order = np.argsort(d, kind="stable")
    d, z = d[order].copy(), z[order].copy()
    tolerance = 8 * np.finfo(float).eps * max(np.abs(d).max(initial=0), np.abs(z).max(initial=0), rho * (z @ z))
    live, rotations = np.abs(rho * z) > tolerance, []
    at = np.flatnonzero(live)
    for k in np.flatnonzero(np.diff(d[at]) <= tolerance):
        previous, i = int(at[k]), int(at[k + 1])
        r = np.hypot(z[previous], z[i])
        rotations.append((previous, i, z[i] / r, z[previous] / r))
        z[previous], z[i], live[previous] = 0, r, False
    return Deflated(order, d, z, live, rotations)


def rotate(q: np.ndarray, p: int, i: int, c: float, s: float) -> None:
    """A rotation of two columns, in place."""
    q[:, p], q[:, i] = c * q[:, p] - s * q[:, i], s * q[:, p] + c * q[:, i]


def merge(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of Q (diag(d) + rho z zᵀ) Qᵀ; Cuppen's merge with deflation."""
    if rho < 0:
        values, vectors = merge(-d[::-1], q[:, ::-1], z[::-1], -rho)
        return -values[::-1], vectors[:, ::-1]
    order, d, z, live, rotations = deflate(d, z, rho)
    q = q[:, order].copy()
    for rotation in rotations:
        rotate(q, *rotation)
    at = np.flatnonzero(live)
    values, vectors = d.copy(), q.copy()
    if len(at):
        dd = d[at]
        pole, x = secular_range(dd, z[at], rho, 0, len(at))
        gap, roots = (dd[:, None] - dd[pole][None, :]) - x[None, :], dd[pole] + x
        # Weights that make the computed roots exact (Löwner), then unit eigenvectors.
        weight = np.copysign(np.exp(weight_logs(dd, rho, 0, pole, x) / 2), z[at])
        u = weight[:, None] / gap
        u /= np.linalg.norm(u, axis=0)
        values[at], vectors[:, at] = roots, q[:, at] @ u
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def tridiagonal_eigensolver(d: np.ndarray, e: np.ndarray, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Cuppen's divide and conquer: ascending values and orthonormal vectors."""
    n, d = len(d), np.array(d, float)
    if not n:
        return d, np.zeros((0, 0))
    edges = [*range(0, n, leaf), n]
    cuts = [(begin, split, end) for begin, split, end in merge_order(len(edges) - 1)]
    for _, split, _ in cuts:
        at = edges[split]
        d[at - 1] -= abs(e[at - 1])
        d[at] -= abs(e[at - 1])
    parts = {}
    for k in range(len(edges) - 1):
        lo, hi = edges[k], edges[k + 1]
        off = e[lo : hi - 1]
        parts[k, k + 1] = np.linalg.eigh(np.diag(d[lo:hi]) + np.diag(off, -1) + np.diag(off, 1))
    for begin, split, end in cuts:
        (d1, q1), (d2, q2) = parts.pop((begin, split)), parts.pop((split, end))
        rho = e[edges[split] - 1]
        q = np.zeros((len(d1) + len(d2),) * 2)
        q[: len(d1), : len(d1)], q[len(d1) :, len(d1) :] = q1, q2
        z = np.concatenate((np.copysign(1.0, rho) * q1[-1], q2[0])) / np.sqrt(2)
        parts[begin, end] = merge(np.concatenate((d1, d2)), q, z, 2 * abs(rho)) if rho else merge(np.concatenate((d1, d2)), q, z, 0.0)
    return parts[0, len(edges) - 1]


def staged_eigensolver(a: np.ndarray, uplo: str, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Band reduction, bulge chasing, divide and conquer and both back-transformations."""
    banded, panels = reduction_to_band(full(a, uplo), band)
    d, e, reflectors = band_to_tridiagonal(banded, band)
    values, vectors = tridiagonal_eigensolver(d, e)
    return values, apply_panels(panels, apply_reflectors(reflectors, vectors))
