"""Placing neighbouring blocks in one partition."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, int_div
from gridlake.operators.blocks import block_counts
from gridlake.operators.shape import at_position, fail_if


@dataclass(frozen=True)
class GridLayout:
    """A ``rows x cols`` array of blocks cut into parts of ``rows_per_part x cols_per_part``."""

    rows: int
    cols: int
    rows_per_part: int
    cols_per_part: int

    def __post_init__(self) -> None:
        if min(self.rows, self.cols, self.rows_per_part, self.cols_per_part) <= 0:
            raise ValueError(f"all sizes must be positive: {self}")

    @property
    def row_parts(self) -> int:
        return ceil(self.rows / self.rows_per_part)

    @property
    def col_parts(self) -> int:
        return ceil(self.cols / self.cols_per_part)

    @property
    def num_partitions(self) -> int:
        return self.row_parts * self.col_parts


def suggest_layout(rows: int, cols: int, partitions: int) -> GridLayout:
    """About ``partitions`` nearly square parts; the exact number may differ."""
    if partitions <= 0:
        raise ValueError(f"the number of partitions must be positive: {partitions}")
    per_part = [floor(max(n / sqrt(partitions), 1.0) + 0.5) for n in (rows, cols)]
    return GridLayout(rows, cols, *per_part)


def grid_partition_id(layout: GridLayout, bi: str = "bi", bj: str = "bj") -> Column:
    """Partition of a block; the query fails for a block outside the layout."""
    row, col = F.col(bi), F.col(bj)
    part = int_div(row, layout.rows_per_part) + int_div(col, layout.cols_per_part) * layout.row_parts
    outside = (row < 0) | (row >= layout.rows) | (col < 0) | (col >= layout.cols)
    return fail_if(outside, at_position("block outside the layout:", bi, bj), part.cast("int"))


def partition_layout(grid: BlockGrid, partitions: int | None = None) -> GridLayout:
    """The layout for a block grid, by default for Spark's number of shuffle partitions."""
    if partitions is None:
        partitions = int(grid.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return suggest_layout(*block_counts(grid), partitions)


def partition_grid(grid: BlockGrid, layout: GridLayout | None = None) -> BlockGrid:
    """The grid with the blocks of each part of the layout in one partition."""
    layout = layout or partition_layout(grid)
    df: DataFrame = grid.df.repartitionById(layout.num_partitions, grid_partition_id(layout))
    return grid.with_df(df)
