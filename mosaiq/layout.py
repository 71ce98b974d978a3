"""Index algebra of tiled matrices: pure integer functions, options and preconditions."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Uplo(Enum):
    LOWER, UPPER, GENERAL = "L", "U", "G"


class Op(Enum):
    NO_TRANS, TRANS, CONJ_TRANS = "N", "T", "C"


class Side(Enum):
    LEFT, RIGHT = "L", "R"


class Diag(Enum):
    NON_UNIT, UNIT = "N", "U"


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def same_sign(a: float, b: float) -> bool:
    return (a < 0) == (b < 0)


def percent_to_index(n: int, percent: float) -> int:
    """Number of leading items of n for a percentage of them, rounded up."""
    if not 0 <= percent <= 100:
        raise ValueError("a percentage is between 0 and 100")
    return min(n, -int(-(n * percent) // 100))


def total_ops(dtype: str, additions: float, multiplications: float) -> float:
    """Real operations: a complex addition is 2, a complex multiplication 6."""
    add, mul = (2, 6) if dtype in "cz" else (1, 1)
    return add * additions + mul * multiplications


def band_size(tile: int, least: int = 100) -> int:
    """The smallest divisor of a tile's size that is at least ``least``; the tile's size if there is none."""
    if least < 2:
        raise ValueError("a band has two diagonals or more")
    for parts in range(tile // least, 1, -1):
        if tile % parts == 0:
            return tile // parts
    return tile


@dataclass(frozen=True)
class Axis:
    """One dimension dealt into tiles, blocks of tiles and a cyclic grid of ranks, from an offset on."""

    size: int
    tile: int
    block: int | None = None
    grid: int = 1
    source: int = 0
    offset: int = 0

    def __post_init__(self) -> None:
        block = self.block or self.tile
        if self.size < 0 or self.tile < 1 or block % self.tile or not 0 <= self.source < self.grid or self.offset < 0:
            raise ValueError(f"not a layout: {self}")

    @property
    def tiles_per_block(self) -> int:
        return (self.block or self.tile) // self.tile

    @property
    def tiles(self) -> int:
        return ceil_div(self.size + self._shift, self.tile) if self.size else 0

    @property
    def _shift(self) -> int:
        return self.offset % self.tile

    @property
    def _first_tile(self) -> int:
        return self.offset // self.tile

    def tile_of(self, element: int) -> int:
        return (element + self._shift) // self.tile

    def inside_tile(self, element: int) -> int:
        at = element + self._shift
        return at - self._shift if at < self.tile else at % self.tile

    def element_of(self, tile: int, inside: int = 0) -> int:
        return inside if tile == 0 else tile * self.tile - self._shift + inside

    def tile_size(self, tile: int) -> int:
        return min(self.element_of(tile + 1), self.size) - self.element_of(tile)

    def rank_of_tile(self, tile: int) -> int:
        return ((tile + self._first_tile) // self.tiles_per_block + self.source) % self.grid

    def local_tile(self, tile: int) -> int:
        """The place of a tile among its rank's own tiles."""
        per, at = self.tiles_per_block, tile + self._first_tile
        first = self._first_tile // per
        mine = (at // per) // self.grid - self._blocks_before(first, at // per)
        inside = at % per
        skipped = self._first_tile % per if (at // per) % self.grid == first % self.grid else 0
        return mine * per + inside - skipped

    def _blocks_before(self, first: int, block: int) -> int:
        """Blocks of a block's rank that lie before the first block."""
        lane = block % self.grid
        return max(0, ceil_div(first - lane, self.grid))

    def global_tile(self, local: int, rank: int) -> int:
        for tile in range(self.tiles):  # short by construction: used for parity with the placement only
            if self.rank_of_tile(tile) == rank and self.local_tile(tile) == local:
                return tile
        raise ValueError("no such tile")

    def next_local_tile(self, tile: int, rank: int) -> int:
        """The local place of the rank's first tile at or after a global tile."""
        return sum(self.rank_of_tile(t) == rank for t in range(tile))


def require(fact: bool, what: str) -> None:
    if not fact:
        raise ValueError(what)
