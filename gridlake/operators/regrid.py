"""Bilinear resampling to another grid size."""

from __future__ import annotations

import logging
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, CellGrid, Grid, int_div
from gridlake.operators.blocks import tasks_for
from gridlake.operators.elementwise import transpose
from gridlake.operators.regrid_tiles import resample_tiles
from gridlake.operators.shape import sum_duplicates, unique_positions, with_dims, within_size
from gridlake.operators.stencil import Square, neighbourhoods, window_values

log = logging.getLogger(__name__)


def regrid_bilinear(grid: Grid, target: tuple[int, int]) -> Grid:
    """Resample to ``target`` rows and columns; the corner cells of both grids coincide.

    Output position ``o`` of ``t`` lies at ``o * (n - 1) / (t - 1)`` among ``n`` source
    positions. Positions are compared as integers, so no output falls on the wrong side of a
    source cell by rounding, and a cell with weight 0 takes no part, even if it is NaN.
    Nothing is joined or broadcast: each source cell, or each window, works out the outputs it
    contributes to. Batch keys make it one job for, say, all time steps.

    There is an output where a cell that is present has a weight above 0, whatever the sizes.

    A finer target collects windows first, shuffles about one row per source cell, and is dealt out by
    the number of outputs before they are made. A coarser one drops the cells between outputs first and
    shuffles at most four rows per output.

    Tiles are resampled as they are, to tiles of the same size: see ``resample_tiles``.
    """
    rows, cols = target
    if rows < 2 or cols < 2:
        raise ValueError(f"the target needs at least 2 rows and 2 columns, got {target}")
    grid = with_dims(grid)
    if grid.nrows < 1 or grid.ncols < 1:
        raise ValueError("cannot resample an empty grid")
    if grid.nrows > rows or grid.ncols > cols:
        log.warning("a target coarser than the grid leaves out cells between outputs")
    if isinstance(grid, BlockGrid):
        return resample_tiles(grid, rows, cols)
    grid = within_size(grid)
    finer = rows * cols >= grid.nrows * grid.ncols
    return _from_windows(grid, rows, cols) if finer else _from_cells(grid, rows, cols)


def interpolate(grid: Grid, target: tuple[int, int]) -> Grid:
    """Bilinear resampling of the transpose of a square grid."""
    grid = with_dims(grid)
    if grid.nrows != grid.ncols:
        raise ValueError(f"needs a square grid, got {grid.nrows} x {grid.ncols}")
    return regrid_bilinear(transpose(grid), target)


def _ceil_div(a: Column, b: int) -> Column:
    return int_div(a + (b - 1), b)


def _outputs_at(index: str, n: int, t: int) -> tuple[Column, Column]:
    """First and last output position that lies in ``[index, index + 1)``."""
    source = F.col(index)
    if n == 1:
        return F.lit(0).cast("bigint"), F.lit(t - 1).cast("bigint")
    first = _ceil_div(source * (t - 1), n - 1)
    last = _ceil_div((source + 1) * (t - 1), n - 1) - 1
    return first, F.least(last, F.lit(t - 1))


def _outputs_near(index: str, n: int, t: int) -> tuple[Column, Column]:
    """First and last output position strictly between ``index - 1`` and ``index + 1``."""
    source = F.col(index)
    if n == 1:
        return F.lit(0).cast("bigint"), F.lit(t - 1).cast("bigint")
    first = F.when(source == 0, 0).otherwise(int_div((source - 1) * (t - 1), n - 1) + 1)
    last = _ceil_div((source + 1) * (t - 1), n - 1) - 1
    return first, F.least(last, F.lit(t - 1))


def _distance(out: str, index: str, n: int, t: int) -> Column:
    """How far output ``out`` lies beyond source ``index``, in source steps."""
    if n == 1:
        return F.lit(0.0)
    return (F.col(out) * (n - 1) - F.col(index) * (t - 1)) / F.lit(t - 1)


def _from_windows(grid: CellGrid, rows: int, cols: int) -> CellGrid:
    windows = neighbourhoods(grid, Square())
    filled = window_values(with_dims(grid), Square())
    axes = {"i": ("oi", grid.nrows, rows), "j": ("oj", grid.ncols, cols)}
    ranges = {index: _outputs_at(index, n, t) for index, (_, n, t) in axes.items()}
    present = F.struct(*[F.col(name).isNotNull().alias(name) for name in filled])
    spread = windows.withColumn("present", present).withColumns(filled)
    for first, last in ranges.values():
        spread = spread.where(first <= last)
    # The outputs appear after the shuffle, so its size says nothing about the work per task. An axis
    # of one source cell, from which all its outputs come, is spread before.
    tasks = tasks_for(grid, rows * cols)
    early = [index for index, (_, n, _) in axes.items() if n == 1]
    late = [index for index in axes if index not in early]
    for index in early:
        spread = spread.withColumn(axes[index][0], F.explode(F.sequence(*ranges[index])))
    spread = spread.repartition(tasks, *grid.keys, "i", "j", *[axes[index][0] for index in early])
    for index in late:
        spread = spread.withColumn(axes[index][0], F.explode(F.sequence(*ranges[index])))
    spread = spread.withColumn("x", _distance("oi", "i", grid.nrows, rows)).withColumn(
        "y", _distance("oj", "j", grid.ncols, cols)
    )

    def part(name: str, wx: Column, wy: Column) -> Column:
        weight = wx * wy
        return F.when(weight == 0, F.lit(0.0)).otherwise(F.col(name) * weight)

    x, y = F.col("x"), F.col("y")
    corners = {"here": (1 - x) * (1 - y), "next_col": (1 - x) * y, "next_row": x * (1 - y), "diag": x * y}
    some = F.lit(False)
    for name, weight in corners.items():
        some = some | ((weight > 0) & F.col("present")[name])
    spread = spread.where(some)
    value = (
        part("here", 1 - x, 1 - y)
        + part("next_col", 1 - x, y)
        + part("next_row", x, 1 - y)
        + part("diag", x, y)
    )
    df = spread.select(*grid.keys, F.col("oi").alias("i"), F.col("oj").alias("j"), value.alias("v"))
    return replace(grid, df=df, nrows=rows, ncols=cols, unique=True)


def _from_cells(grid: CellGrid, rows: int, cols: int) -> CellGrid:
    grid = unique_positions(grid)
    first_i, last_i = _outputs_near("i", grid.nrows, rows)
    first_j, last_j = _outputs_near("j", grid.ncols, cols)
    shares = (
        grid.df.where((first_i <= last_i) & (first_j <= last_j))
        .withColumn("oi", F.explode(F.sequence(first_i, last_i)))
        .withColumn("oj", F.explode(F.sequence(first_j, last_j)))
    )
    weight_i = 1 - F.abs(_distance("oi", "i", grid.nrows, rows))
    weight_j = 1 - F.abs(_distance("oj", "j", grid.ncols, cols))
    shares = shares.select(
        *grid.keys,
        F.col("oi").alias("i"),
        F.col("oj").alias("j"),
        (F.col("v") * (weight_i * weight_j)).alias("v"),
    )
    spread = replace(grid, df=shares, nrows=rows, ncols=cols, unique=False)
    return sum_duplicates(spread)
