"""One function for each operation, and the library-style entry points by letter (s, d, c, z)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from .layout import require
from .matrix import TiledMatrix
from .operators.eigen import Eigen, heevd, hegvd
from .operators.factor import NotPositiveDefinite, potrf
from .operators.multiply import add, chain, gemm, hemm, her2k, herk, lauum, scale_columns, trmm
from .operators.shape import max_norm, paste, permute
from .operators.solve import hegst, potri, trsm, trtri


@dataclass(frozen=True)
class Descriptor:
    """Sizes of a matrix and its blocks; i and j count from 1 and must be 1."""

    m: int
    n: int
    mb: int
    nb: int
    isrc: int = 0
    jsrc: int = 0
    i: int = 1
    j: int = 1
    ld: int = 1

    def __post_init__(self) -> None:
        require(self.i == 1 and self.j == 1, "a matrix starts at its first element")


def _typed(letter: str, *matrices: TiledMatrix) -> None:
    for a in matrices:
        if a.dtype != letter:
            raise TypeError(f"the matrix has elements of type {a.dtype}, not {letter}")


def _entry_points(letter: str) -> dict[str, Callable]:
    kind = "he" if letter in "cz" else "sy"

    def p_potrf(uplo: str, a: TiledMatrix) -> tuple[TiledMatrix, int]:
        """The factor and 0, or the matrix and the order of the first minor that isn't positive."""
        _typed(letter, a)
        try:
            return potrf(uplo, a).stored("factor"), 0
        except NotPositiveDefinite as error:
            return a, error.order
        except Exception as error:  # raised in a task
            if "NotPositiveDefinite" not in str(error):
                raise
            return a, int(str(error).partition("leading minor of order ")[2].split()[0])

    def p_potri(uplo: str, a: TiledMatrix) -> tuple[TiledMatrix, int]:
        _typed(letter, a)
        return potri(uplo, a), 0

    def solver(uplo: str, a: TiledMatrix, begin: int = 0, end: int | None = None) -> Eigen:
        _typed(letter, a)
        require(begin == 0, "a partial spectrum starts at the first eigenvalue")
        return heevd(uplo, a, end)

    def generalized(uplo: str, a: TiledMatrix, b: TiledMatrix, begin: int = 0, end: int | None = None, factorized: bool = False) -> Eigen:
        _typed(letter, a, b)
        require(begin == 0, "a partial spectrum starts at the first eigenvalue")
        return hegvd(uplo, a, b, factorized, end)

    # The p-names count from 1 and include the last eigenvalue.
    return {
        f"cholesky_factorization_{letter}": lambda uplo, a: p_potrf(uplo, a)[0],
        f"p{letter}potrf": p_potrf,
        f"inverse_from_cholesky_factor_{letter}": lambda uplo, a: p_potri(uplo, a)[0],
        f"p{letter}potri": p_potri,
        f"{'hermitian' if kind == 'he' else 'symmetric'}_eigensolver_{letter}": solver,
        f"{'hermitian' if kind == 'he' else 'symmetric'}_eigensolver_partial_spectrum_{letter}": solver,
        f"p{letter}{kind}evd": lambda uplo, a: solver(uplo, a),
        f"p{letter}{kind}evd_partial_spectrum": lambda uplo, a, first, last: solver(uplo, a, first - 1, last),
        f"{'hermitian' if kind == 'he' else 'symmetric'}_generalized_eigensolver_{letter}": generalized,
        f"{'hermitian' if kind == 'he' else 'symmetric'}_generalized_eigensolver_factorized_{letter}": lambda uplo, a, b, *range_: generalized(uplo, a, b, *range_, factorized=True),
        f"{'hermitian' if kind == 'he' else 'symmetric'}_generalized_eigensolver_partial_spectrum_{letter}": generalized,
        f"{'hermitian' if kind == 'he' else 'symmetric'}_generalized_eigensolver_partial_spectrum_factorized_{letter}": lambda uplo, a, b, *range_: generalized(uplo, a, b, *range_, factorized=True),
        f"p{letter}{kind}gvd": lambda uplo, a, b: generalized(uplo, a, b),
        f"p{letter}{kind}gvd_partial_spectrum": lambda uplo, a, b, first, last: generalized(uplo, a, b, first - 1, last),
        f"p{letter}{kind}gvd_factorized": lambda uplo, a, b: generalized(uplo, a, b, factorized=True),
        f"p{letter}{kind}gvd_partial_spectrum_factorized": lambda uplo, a, b, first, last: generalized(uplo, a, b, first - 1, last, factorized=True),
    }


ENTRY_POINTS: dict[str, Callable] = {name: f for letter in "sdcz" for name, f in _entry_points(letter).items()}

__all__ = ["ENTRY_POINTS", "Descriptor", "add", "chain", "gemm", "heevd", "hegst", "hegvd", "hemm", "her2k", "herk", "lauum", "max_norm", "paste", "permute", "potrf", "potri", "scale_columns", "trmm", "trsm", "trtri"]
