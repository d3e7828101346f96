"""The two encodings of a two-dimensional grid.

Both are plain DataFrames; the dataclasses only carry what a DataFrame cannot say
about itself: the claimed size, the tile size and which facts are already known.
An absent cell or block stands for zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that operators use for columns of their own; batch keys need other names.
RESERVED = frozenset(
    "i j v bi bj nr nc vals a b k x y at end segment cells copies block repeated part step here "
    "next_row next_col diag si sj oi oj rule detail found fits nr_min nr_max nc_min nc_max present salt side strip "
    "south east corner sent out_nr out_nc begin rest to asked".split()
)

BLOCK_SCHEMA = "bi INT, bj INT, nr INT, nc INT, vals ARRAY<DOUBLE>"


def _check_keys(keys: tuple[str, ...]) -> None:
    taken = RESERVED.intersection(keys)
    if taken:
        raise ValueError(f"rename these batch keys: {', '.join(sorted(taken))}")


@dataclass(frozen=True)
class CellGrid:
    """One row per cell: ``i BIGINT, j BIGINT, v DOUBLE`` after optional batch keys.

    ``nrows``/``ncols`` may be ``None``: operators that need them derive them with a job.
    ``unique`` records that no cell occurs twice and ``dense`` that every cell of the
    claimed size is present; operators use them to leave out work.
    """

    df: DataFrame
    nrows: int | None = None
    ncols: int | None = None
    keys: tuple[str, ...] = ()
    unique: bool = False
    dense: bool = False

    def __post_init__(self) -> None:
        _check_keys(self.keys)

    @property
    def position(self) -> list[str]:
        return [*self.keys, "i", "j"]

    def with_df(self, df: DataFrame, **changes) -> CellGrid:
        return replace(self, df=df, **changes)


@dataclass(frozen=True)
class BlockGrid:
    """One row per tile: ``bi, bj, nr, nc, vals``, values in column-major order.

    Tiles on the bottom and right edges may be smaller than
    ``rows_per_block x cols_per_block``. ``packed`` holds a ``df``, the tiles that it was made of, with
    ``cells``, a sorted array of ``(k, v)``, for ``vals``, and what the absent cells of such a tile are: a
    function of row and column, or ``None`` for zeros.
    """

    df: DataFrame
    rows_per_block: int
    cols_per_block: int
    nrows: int | None = None
    ncols: int | None = None
    keys: tuple[str, ...] = ()
    unique: bool = False
    dense: bool = False
    packed: tuple[DataFrame, DataFrame, Callable[[Column, Column], Column] | None] | None = None

    def __post_init__(self) -> None:
        _check_keys(self.keys)
        if self.rows_per_block <= 0 or self.cols_per_block <= 0:
            raise ValueError(
                "tile sizes must be positive, got "
                f"{self.rows_per_block} x {self.cols_per_block}"
            )

    @property
    def position(self) -> list[str]:
        return [*self.keys, "bi", "bj"]

    def with_df(self, df: DataFrame, **changes) -> BlockGrid:
        return replace(self, df=df, **changes)

    def parts(self) -> tuple[DataFrame, Callable[[Column, Column], Column] | None] | None:
        """The tiles with ``cells`` for ``vals``, and what absent cells are, if ``df`` was made of such."""
        return self.packed[1:] if self.packed and self.packed[0] is self.df else None

    def sparse(self) -> DataFrame | None:
        """The tiles with ``cells`` for ``vals``, if ``df`` was made of such and absent cells are zeros."""
        parts = self.parts()
        return parts[0] if parts and parts[1] is None else None


Grid = CellGrid | BlockGrid


def num_blocks(n: int, size: int) -> int:
    return ceil(n / size)


def int_div(a: Column, b: Column | int) -> Column:
    """Whole-number quotient of two non-negative integers."""
    return F.call_function("div", a, F.lit(b))


def block_index(index: Column | str, size: int) -> Column:
    """Number of the tile that holds ``index`` (indices are never negative)."""
    index = F.col(index) if isinstance(index, str) else index
    return int_div(index, size).cast("int")


def offset_in_block(index: Column | str, size: int) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.pmod(index, F.lit(size))


def global_index(block: Column | str, offset: Column | str, size: int) -> Column:
    """Inverse of ``block_index`` and ``offset_in_block``."""
    block = F.col(block) if isinstance(block, str) else block
    offset = F.col(offset) if isinstance(offset, str) else offset
    return block.cast("bigint") * F.lit(size) + offset


def same_shape(a: Grid, b: Grid) -> None:
    """Raise unless two grids can be combined cell by cell."""
    if (a.nrows, a.ncols) != (b.nrows, b.ncols):
        raise ValueError(
            f"grids differ in size: {a.nrows} x {a.ncols} and {b.nrows} x {b.ncols}"
        )
    if a.keys != b.keys:
        raise ValueError(f"grids differ in batch keys: {a.keys} and {b.keys}")
