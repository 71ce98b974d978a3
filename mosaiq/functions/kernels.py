"""Dense kernels on numpy arrays: what a task does with the tiles it has.

Only the named triangle of a triangular or Hermitian operand is read; the other may hold anything.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


class NotPositiveDefinite(ValueError):
    """The leading minor of this order isn't positive."""

    def __init__(self, order: int):
        super().__init__(f"the leading minor of order {order} is not positive definite")
        self.order = order


def op(a: np.ndarray, how: str) -> np.ndarray:
    return a if how == "N" else a.T if how == "T" else a.conj().T


def triangle(a: np.ndarray, uplo: str, diag: str = "N") -> np.ndarray:
    """The triangle with zeros elsewhere, with ones on the diagonal if unit."""
    if uplo == "G":
        return a.copy()
    out = np.tril(a) if uplo == "L" else np.triu(a)
    if diag == "U":
        k = np.arange(min(out.shape))
        out[k, k] = 1
    return out


def full(a: np.ndarray, uplo: str) -> np.ndarray:
    """The Hermitian matrix of which a triangle is given; imaginary parts of the diagonal are taken as zero."""
    if uplo == "G":
        return a.copy()
    strict = np.tril(a, -1) if uplo == "L" else np.triu(a, 1)
    return strict + strict.conj().T + np.diag(np.diag(a).real).astype(a.dtype)


def gemm(a, b, c=None, alpha=1, beta=0, opa="N", opb="N"):
    out = alpha * (op(a, opa) @ op(b, opb))
    return out if c is None or beta == 0 else out + beta * c


def hemm(side, uplo, a, b, c=None, alpha=1, beta=0):
    h = full(a, uplo)
    return gemm(h, b, c, alpha, beta) if side == "L" else gemm(b, h, c, alpha, beta)


def herk(uplo, a, c, alpha=1.0, beta=1.0, how="N"):
    x = op(a, "N" if how == "N" else "C")
    return np.where(_mask(c, uplo), alpha * (x @ x.conj().T) + beta * c, c)


def her2k(uplo, a, b, c, alpha=1, beta=1.0, how="N"):
    x, y = (a, b) if how == "N" else (a.conj().T, b.conj().T)
    return np.where(_mask(c, uplo), alpha * (x @ y.conj().T) + np.conj(alpha) * (y @ x.conj().T) + beta * c, c)


def _mask(c, uplo):
    i, j = np.indices(c.shape)
    return i >= j if uplo == "L" else i <= j if uplo == "U" else np.ones(c.shape, bool)


def trmm(side, uplo, how, diag, a, b, alpha=1):
    t = op(triangle(a, uplo, diag), how)
    return alpha * (t @ b) if side == "L" else alpha * (b @ t)


def _lower_solve(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Forward substitution by blocks: a small dense solve for each diagonal block, products for the rest."""
    x = b.copy()
    for k in range(0, len(t), BLOCK):
        z = k + BLOCK
        x[k:z] = np.linalg.solve(t[k:z, k:z], x[k:z] - t[k:z, :k] @ x[:k])
    return x


def trsm(side, uplo, how, diag, a, b, alpha=1):
    """X of op(A) X = alpha B or X op(A) = alpha B; zeros if alpha is zero."""
    out = np.result_type(a, b)
    if alpha == 0 or b.size == 0:
        return np.zeros(b.shape, out)
    t = op(triangle(a, uplo, diag), how)
    if side == "R":
        t, b = t.T, b.T
    lower = (uplo == "L") == (how == "N") if side == "L" else (uplo == "L") != (how == "N")
    b = (alpha * b).astype(out)
    x = _lower_solve(t, b) if lower else _lower_solve(t[::-1, ::-1], b[::-1])[::-1]
    return x if side == "L" else x.T


def potrf_info(uplo, a) -> tuple[np.ndarray, int]:
    """The factor in its triangle and 0, or the order of the first minor that isn't positive."""
    h = full(a, uplo)
    try:
        factor = np.linalg.cholesky(h)
    except np.linalg.LinAlgError:
        lo, hi = 0, len(h)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            try:
                np.linalg.cholesky(h[:mid, :mid])
                lo = mid
            except np.linalg.LinAlgError:
                hi = mid
        return a, hi
    factor = factor if uplo == "L" else factor.conj().T
    return np.where(_mask(a, uplo), factor, a), 0


def potrf(uplo, a):
    out, info = potrf_info(uplo, a)
    if info:
        raise NotPositiveDefinite(info)
    return out


def trtri_info(uplo, diag, a) -> tuple[np.ndarray, int]:
    zero = np.flatnonzero(np.diag(a) == 0)
    if diag == "N" and len(zero):
        return a, int(zero[0]) + 1
    x = trsm("L", uplo, "N", diag, a, np.eye(len(a), dtype=a.dtype))
    keep = _mask(a, uplo)
    if diag == "U":
        keep = keep & ~np.eye(len(a), dtype=bool)
    return np.where(keep, x, a), 0


def trtri(uplo, diag, a):
    out, info = trtri_info(uplo, diag, a)
    if info:
        raise ZeroDivisionError(f"the diagonal element {info} is zero")
    return out


def lauum(uplo, a):
    t = triangle(a, uplo)
    return np.where(_mask(a, uplo), t.conj().T @ t if uplo == "L" else t @ t.conj().T, a)


def potri(uplo, a):
    return lauum(uplo, trtri(uplo, "N", a))


def hegst(itype, uplo, a, b):
    """itype 1: inv(L) A inv(Lᴴ) or inv(Uᴴ) A inv(U); 2, 3: Lᴴ A L or U A Uᴴ. In A's triangle."""
    h = full(a, uplo)
    if itype == 1:
        left = trsm("L", uplo, "N" if uplo == "L" else "C", "N", b, h)
        out = trsm("R", uplo, "C" if uplo == "L" else "N", "N", b, left)
    else:
        t = triangle(b, uplo)
        out = t.conj().T @ h @ t if uplo == "L" else t @ h @ t.conj().T
    return np.where(_mask(a, uplo), out, a)


def lange(kind, a) -> float:
    if a.size == 0:
        return 0.0
    m = np.abs(a)
    return float({"M": lambda: m.max(), "1": lambda: m.sum(axis=0).max(), "I": lambda: m.sum(axis=1).max(), "F": lambda: np.sqrt((m**2).sum())}[kind]())


def lantr(kind, uplo, diag, a) -> float:
    return lange(kind, triangle(a, uplo, diag))


def add(alpha, b, a):
    return a + alpha * b


def scal(beta, a):
    return beta * a if beta != 0 else np.zeros_like(a)


def laset(uplo, alpha, beta, a):
    """Off-diagonal elements of the triangle become alpha, the diagonal beta."""
    out = np.where(_mask(a, uplo), alpha, a).astype(a.dtype)
    k = np.arange(min(a.shape))
    out[k, k] = beta
    return out


def lacpy(uplo, a, b):
    return np.where(_mask(a, uplo), a, b)


def scale_columns(a, factors):
    return a * np.asarray(factors)[None, :]


def stedc(d, e):
    return np.linalg.eigh(np.diag(d) + np.diag(e, -1) + np.diag(e, 1))


def larfg(x: np.ndarray) -> tuple[np.ndarray, complex, float]:
    """v (v[0] = 1), tau and real beta with (1 - tau v vᴴ)ᴴ x = beta e0; tau is 0 where nothing is to be done."""
    x = np.asarray(x)
    v = np.zeros_like(x)
    if not len(x):
        return v, 0.0, 0.0
    v[0] = 1
    alpha, rest = x[0], np.linalg.norm(x[1:])
    if rest == 0 and np.imag(alpha) == 0:
        return v, 0.0 * alpha, float(np.real(alpha))
    beta = -np.copysign(np.hypot(abs(alpha), rest), np.real(alpha))
    v[1:] = x[1:] / (alpha - beta)
    return v, (beta - alpha) / beta, float(beta)


def larft(v: np.ndarray, taus: np.ndarray) -> np.ndarray:
    """Upper T with H0 H1 ... = 1 - V T Vᴴ."""
    k = v.shape[1]
    t, gram = np.zeros((k, k), np.result_type(v, taus)), v.conj().T @ v
    for j in range(k):
        t[:j, j] = -taus[j] * (t[:j, :j] @ gram[:j, j])
        t[j, j] = taus[j]
    return t


def householder_panel(panel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """QR of a panel: V (unit lower trapezoid), taus and R, with panel = (H0 H1 ...) R."""
    a = panel.copy()
    m, n = a.shape
    k = min(m, n)
    v, taus = np.zeros((m, k), a.dtype), np.zeros(k, a.dtype)
    for j in range(k):
        w, tau, beta = larfg(a[j:, j])
        a[j:, j + 1 :] -= np.conj(tau) * np.outer(w, w.conj() @ a[j:, j + 1 :])
        a[j:, j] = 0
        a[j, j] = beta
        v[j:, j], taus[j] = w, tau
    return v, taus, a
