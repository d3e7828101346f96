"""Sizes and integrity of grids: derived dimensions, duplicates, tile validation."""

from __future__ import annotations

from functools import singledispatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, CellGrid, Grid, num_blocks

RULES = ("size", "duplicate", "shape", "values")


@singledispatch
def dims(grid) -> DataFrame:
    """One row ``nrows, ncols``: the smallest size that holds every cell present.

    Only index columns are read, so the values of a Parquet-backed grid are never fetched.
    """
    raise TypeError(f"not a grid: {type(grid).__name__}")


@dims.register
def _(grid: CellGrid) -> DataFrame:
    return grid.df.agg(
        (F.max("i") + 1).alias("nrows"),
        (F.max("j") + 1).alias("ncols"),
    )


@dims.register
def _(grid: BlockGrid) -> DataFrame:
    bottom = F.col("bi").cast("bigint") * grid.rows_per_block + F.col("nr")
    right = F.col("bj").cast("bigint") * grid.cols_per_block + F.col("nc")
    return grid.df.agg(F.max(bottom).alias("nrows"), F.max(right).alias("ncols"))


def with_dims(grid: Grid, check: bool = False) -> Grid:
    """Fill in unknown sizes from the data; this runs a job.

    With ``check`` the job also runs for claimed sizes and raises when the data exceeds them.
    """
    if grid.nrows is not None and grid.ncols is not None and not check:
        return grid
    found = dims(grid).first()
    nrows, ncols = found.nrows or 0, found.ncols or 0
    for axis, have, claimed in (("rows", nrows, grid.nrows), ("columns", ncols, grid.ncols)):
        if claimed is not None and have > claimed:
            raise ValueError(f"the data has {have} {axis}, more than the claimed {claimed}")
    return grid.with_df(
        grid.df,
        nrows=nrows if grid.nrows is None else grid.nrows,
        ncols=ncols if grid.ncols is None else grid.ncols,
    )


def size_estimate_mb(grid: Grid) -> DataFrame:
    """``dims`` plus the memory, in MB, a dense array of that size would take."""
    return dims(grid).withColumn("mb", F.expr("nrows * ncols div 125000"))


def fail_if(condition: Column, message: Column, value: Column) -> Column:
    """``value``, or a failed query where ``condition`` holds."""
    return F.when(condition, F.raise_error(message)).otherwise(value)


def at_position(text: str, *names: str) -> Column:
    where = [F.concat(F.lit(f" {name}="), F.col(name).cast("string")) for name in names]
    return F.concat(F.lit(text), *where)


@singledispatch
def within_size(grid):
    """The grid, of known size, with the query failing at a cell or block outside the claimed size.

    The test is part of the index columns, so that no filter on them can drop such a row first.
    """
    raise TypeError(f"not a grid: {type(grid).__name__}")


@within_size.register
def _(grid: CellGrid) -> CellGrid:
    i, j = F.col("i"), F.col("j")
    outside = (i < 0) | (j < 0) | (i >= F.lit(grid.nrows)) | (j >= F.lit(grid.ncols))
    checked = fail_if(outside, at_position("cell outside the claimed size:", "i", "j"), i)
    return grid.with_df(grid.df.select(*grid.keys, checked.alias("i"), "j", "v"))


@within_size.register
def _(grid: BlockGrid) -> BlockGrid:
    bottom = F.col("bi").cast("bigint") * grid.rows_per_block + F.col("nr")
    right = F.col("bj").cast("bigint") * grid.cols_per_block + F.col("nc")
    outside = (F.col("bi") < 0) | (F.col("bj") < 0) | (bottom > F.lit(grid.nrows)) | (right > F.lit(grid.ncols))
    checked = fail_if(outside, at_position("block outside the claimed size:", "bi", "bj"), F.col("bi"))
    df = grid.df.select(*grid.keys, checked.alias("bi"), "bj", "nr", "nc", "vals")
    tiles = grid.sparse()
    if tiles is None:
        return grid.with_df(df)
    return grid.with_df(df, packed=(df, tiles.select(*grid.keys, checked.alias("bi"), "bj", "nr", "nc", "cells"), None))


@singledispatch
def unique_positions(grid):
    """The grid, with the query failing if any cell or block occurs twice.

    Repeats are counted by an aggregate with a map-side part, so however many copies one
    position has, each task ships at most one of them.
    """
    raise TypeError(f"not a grid: {type(grid).__name__}")


@unique_positions.register
def _(grid: CellGrid) -> CellGrid:
    if grid.unique:
        return grid
    counted = grid.df.groupBy(*grid.position).agg(
        F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")
    )
    checked = fail_if(
        F.col("copies") > 1, at_position("cell occurs more than once:", "i", "j"), F.col("v")
    )
    return grid.with_df(counted.select(*grid.position, checked.alias("v")), unique=True)


@unique_positions.register
def _(grid: BlockGrid) -> BlockGrid:
    if grid.unique:
        return grid
    counted = grid.df.groupBy(*grid.position).agg(
        F.count(F.lit(1)).alias("copies"),
        F.any_value(F.struct("nr", "nc", "vals")).alias("block"),
    )
    checked = fail_if(
        F.col("copies") > 1, at_position("block occurs more than once:", "bi", "bj"), F.col("block")
    )
    df = counted.select(*grid.position, checked.alias("block")).select(*grid.position, "block.*")
    return grid.with_df(df, unique=True)


def sum_duplicates(grid: CellGrid) -> CellGrid:
    """Merge repeated cells into their sum."""
    if grid.unique:
        return grid
    return grid.with_df(
        grid.df.groupBy(*grid.position).agg(F.sum("v").alias("v")), unique=True
    )


def block_info(grid: BlockGrid) -> DataFrame:
    """Position and extent of every block; ``vals`` is pruned from the scan."""
    return grid.df.select(*grid.position, "nr", "nc")


def duplicate_blocks(grid: BlockGrid) -> DataFrame:
    """Block positions that occur more than once, with their number of copies."""
    return (
        grid.df.groupBy(*grid.position)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def _extent_ok(index: str, low: str, high: str, full: int, blocks: int) -> Column:
    interior = F.col(index) < blocks - 1
    return F.when(interior, (F.col(low) == full) & (F.col(high) == full)).otherwise(
        (F.col(low) > 0) & (F.col(high) <= full)
    )


def violations(grid: BlockGrid, values: bool = False) -> DataFrame:
    """Every broken rule as ``bi, bj, rule, detail``; empty for a valid grid.

    ``size``: the block reaches beyond the claimed size. ``duplicate``: the position occurs
    more than once. ``shape``: an interior block is not a full tile, or an edge block is
    empty or larger than a tile. ``values``, only tested if asked for because it reads the values: a
    block has not as many values as its extent says. All come from one aggregate over block positions.
    """
    grid = with_dims(grid)
    rows, cols = grid.rows_per_block, grid.cols_per_block
    fits = F.coalesce(F.size("vals") == F.col("nr") * F.col("nc"), F.lit(False)) if values else F.lit(True)
    summary = grid.df.groupBy(*grid.position).agg(
        F.bool_and(fits).alias("fits"),
        F.count(F.lit(1)).alias("copies"),
        F.min("nr").alias("nr_min"),
        F.max("nr").alias("nr_max"),
        F.min("nc").alias("nc_min"),
        F.max("nc").alias("nc_max"),
    )
    bottom = F.col("bi").cast("bigint") * rows + F.col("nr_max")
    right = F.col("bj").cast("bigint") * cols + F.col("nc_max")
    broken = {
        "size": (bottom > grid.nrows) | (right > grid.ncols),
        "duplicate": F.col("copies") > 1,
        "shape": ~(
            _extent_ok("bi", "nr_min", "nr_max", rows, num_blocks(grid.nrows, rows))
            & _extent_ok("bj", "nc_min", "nc_max", cols, num_blocks(grid.ncols, cols))
        ),
        "values": ~F.col("fits"),
    }
    detail = {
        "size": F.concat_ws(" ", F.lit("reaches"), bottom.cast("string"), right.cast("string")),
        "duplicate": F.concat_ws(" ", F.col("copies").cast("string"), F.lit("copies")),
        "shape": F.concat_ws(" ", F.lit("is"), F.col("nr_max").cast("string"), F.col("nc_max").cast("string")),
        "values": F.lit("has too few or too many values"),
    }
    found = F.array_compact(
        F.array(
            *[
                F.when(broken[rule], F.struct(F.lit(rule).alias("rule"), detail[rule].alias("detail")))
                for rule in RULES
            ]
        )
    )
    return summary.select(*grid.position, F.explode(found).alias("found")).select(
        *grid.position, "found.rule", "found.detail"
    )


def validate(grid: BlockGrid, values: bool = False) -> None:
    """Run ``violations`` and raise on the most basic rule that is broken."""
    rank = F.array_position(F.array(*[F.lit(rule) for rule in RULES]), F.col("rule"))
    worst = violations(grid, values).orderBy(rank, *grid.position).first()
    if worst is not None:
        raise ValueError(
            f"block ({worst.bi}, {worst.bj}) breaks the {worst.rule} rule: {worst.detail}"
        )
