"""Where two grids differ, found by hashes of ranges of positions."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, CellGrid, Grid, block_index, same_shape
from gridlake.operators.blocks import most_tasks, to_cells
from gridlake.operators.shape import with_dims

# The axes are cut into so many ranges at first: 64 x 64 hashes from a task, however large the grid.
RANGES = 64
# Ranges that differ are cut again, 8 x 8, while there are at most so many and they have so many cells.
FEW = 64
SPLIT = 8
LEAST_CELLS = 1 << 14
# Beyond so many ranges, a task does not keep a hash of each while its cells are made: these are shuffled.
MANY_RANGES = 1 << 16


def _cells(grid: Grid) -> CellGrid:
    grid = with_dims(to_cells(grid) if isinstance(grid, BlockGrid) else grid)
    if not grid.unique:
        raise ValueError("hashes need grids known to have no repeats")
    return grid


def _located(grid: CellGrid, by: list[str], rows: int, cols: int, sign: int, tasks: int | None) -> DataFrame:
    """Each cell that is not zero, with its range."""
    cells = grid.df.where("v != 0").select(
        *grid.position,
        "v",
        block_index("i", rows).alias("bi"),
        block_index("j", cols).alias("bj"),
        F.lit(sign).alias("side"),
    )
    return cells if tasks is None else cells.repartition(tasks, *by)


def _differing(a: CellGrid, b: CellGrid, by: list[str], rows: int, cols: int, tasks: int | None = None) -> DataFrame:
    """The ranges that differ; with ``tasks``, cells go to so many by their ranges before they are hashed."""

    def mixed(salt: int) -> Column:
        return F.xxhash64(F.lit(salt), *a.position, F.lit(salt), "v")

    # Each grid is shuffled by itself: a task of a union of grids may hold what makes the cells of both.
    cells = _located(a, by, rows, cols, 1, tasks).unionByName(_located(b, by, rows, cols, -1, tasks))
    # Two hashes of each cell. The value is part of them, -0.0 is 0. What both grids have cancels out.
    # Without tasks the hashes are combined before the shuffle.
    both = cells.select(*by, mixed(1).alias("a"), mixed(2).alias("b"), "side", F.isnan("v").alias("found"))
    summary = both.groupBy(*by).agg(
        F.bit_xor("a").alias("a"),
        F.bit_xor("b").alias("b"),
        F.sum("side").alias("side"),
        F.bool_or("found").alias("found"),
    )
    return summary.where("a != 0 OR b != 0 OR side != 0 OR found").select(*by)


def differing_ranges(a: Grid, b: Grid, rows: int, cols: int) -> DataFrame:
    """The ranges of ``rows x cols`` cells in which two grids of one size differ: batch keys, ``bi, bj``.

    Both grids must be known to have no repeats. Absent cells, nulls and -0.0 are zeros, and NaN differs
    from everything. A task sends one row for each range: an order-free hash of 128 bits, so a range
    that differs is missed with a chance of 2**-128. Of more than ``MANY_RANGES`` small ranges, cells are
    shuffled to the tasks of their ranges instead, so that no task holds a large part of all hashes.
    """
    if rows <= 0 or cols <= 0:
        raise ValueError(f"ranges must have rows and columns: {rows} x {cols}")
    a, b = _cells(a), _cells(b)
    same_shape(a, b)
    many = ceil((a.nrows or 1) / rows) * ceil((a.ncols or 1) / cols) > MANY_RANGES and rows * cols <= LEAST_CELLS
    tasks = most_tasks(a.df.sparkSession) if many else None
    return _differing(a, b, [*a.keys, "bi", "bj"], rows, cols, tasks)


def _within(grid: CellGrid, found: list, rows: int, cols: int) -> CellGrid:
    """The cells in some ranges, of which there are few by construction."""
    spark = grid.df.sparkSession
    ranges = F.broadcast(spark.createDataFrame(found, "bi INT, bj INT"))
    located = grid.df.withColumns({"bi": block_index("i", rows), "bj": block_index("j", cols)})
    return grid.with_df(located.join(ranges, ["bi", "bj"], "left_semi").select(*grid.position, "v"), dense=False)


def narrowed(a: Grid, b: Grid) -> tuple[CellGrid, CellGrid]:
    """Two grids of one size, each cut to ranges in which they differ, from the top down.

    The first job hashes 64 x 64 ranges of all batches together. Where few of them differ, these are cut
    into 8 x 8, and so on. At most 81 times 64 ranges come to the driver and are broadcast, whatever the
    size of the grids. Each level reads the grids again, so this pays where what differs is far less than
    the grid; where nearly all ranges differ, the first level is the last.
    """
    a, b = _cells(a), _cells(b)
    same_shape(a, b)
    rows, cols = (max(1, ceil((n or 1) / RANGES)) for n in (a.nrows, a.ncols))
    while True:
        found = [(r.bi, r.bj) for r in _differing(a, b, ["bi", "bj"], rows, cols).collect()]
        ranges_now = ceil((a.nrows or 1) / rows) * ceil((a.ncols or 1) / cols)
        if len(found) < ranges_now:
            a, b = (_within(grid, found, rows, cols) for grid in (a, b))
        if not found or len(found) > FEW or rows * cols <= LEAST_CELLS:
            return a, b
        rows, cols = (max(1, ceil(n / SPLIT)) for n in (rows, cols))
