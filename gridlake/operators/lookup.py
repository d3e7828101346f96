"""Values of a grid at positions that a table asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.grid import BlockGrid, CellGrid, Grid, block_index, offset_in_block
from gridlake.operators.shape import at_position, fail_if, unique_positions, with_dims

# So many tiles that are asked for are named to the scan; beyond that, the join alone finds them.
MAX_NAMED = 1000


def _bounded(grid: Grid, name: str, size: int) -> Column:
    outside = (F.col(name) < 0) | (F.col(name) >= F.lit(size))
    return fail_if(outside, at_position("position outside the grid:", "i", "j"), F.col(name).cast("bigint"))


def lookup(grid: Grid, positions: DataFrame) -> DataFrame:
    """``positions`` with ``v``, the value of ``grid`` at each row's ``i, j`` (and batch keys).

    An absent cell or tile gives 0, a null in ``i``, ``j`` or a batch key gives null, and a position outside
    the grid fails. Other columns stay as they are; ``v`` is replaced. Positions may repeat.

    Of tiles, only the number that a position picks leaves its array, so rows stay small after the
    join. Where few tiles are asked for, one job lists them, at most ``MAX_NAMED``, and their range and
    numbers limit the scan of a stored grid; a stored layout is not shuffled. Tiles that are at hand without
    their zeros are joined so.
    """
    grid = unique_positions(with_dims(grid))
    missing = {*grid.keys, "i", "j"} - {*positions.columns}
    if missing:
        raise ValueError(f"positions lack columns: {', '.join(sorted(missing))}")
    kept = [c for c in positions.columns if c != "v"]
    # Names of its own for everything joined, so that other columns of positions cannot clash.
    asked = positions.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("asked"), *grid.keys, "i", "j")
    known = F.col("i").isNotNull() & F.col("j").isNotNull()
    for key in grid.keys:
        known = known & F.col(key).isNotNull()
    asked = asked.withColumns({"i": _bounded(grid, "i", grid.nrows), "j": _bounded(grid, "j", grid.ncols)})
    if isinstance(grid, CellGrid):
        found = asked.join(grid.df.select(*grid.position, F.lit(True).alias("present"), "v"), grid.position, "left")
        value = F.col("v")
    else:
        asked = asked.withColumns({"bi": block_index("i", grid.rows_per_block), "bj": block_index("j", grid.cols_per_block)})
        sparse = grid.sparse()
        tiles = _wanted(grid, grid.df if sparse is None else sparse, asked)
        stored = "vals" if sparse is None else "cells"
        found = asked.join(tiles.select(*grid.position, F.lit(True).alias("present"), "nr", stored), grid.position, "left")
        row, col = offset_in_block("i", grid.rows_per_block), offset_in_block("j", grid.cols_per_block)
        k = (col * F.col("nr") + row).cast("int")
        if sparse is None:
            value = F.get("vals", k)
        else:
            at = F.array_position(F.col("cells")["k"], k).cast("int")
            value = F.when(at > 0, F.get(F.col("cells")["v"], at - 1)).otherwise(F.lit(0.0))
    value = F.when(known, F.when(F.col("present"), value).otherwise(F.lit(0.0)))
    return found.select("asked.*", value.alias("v"))


def _wanted(grid: BlockGrid, tiles: DataFrame, asked: DataFrame) -> DataFrame:
    """The tiles of a grid, limited to those that are asked for if they are few."""
    wanted = asked.select("bi", "bj").where("bi IS NOT NULL AND bj IS NOT NULL").distinct().limit(MAX_NAMED + 1).collect()
    if len(wanted) > MAX_NAMED:
        return tiles
    limits = F.lit(True)
    for name in ("bi", "bj"):
        numbers = sorted({r[name] for r in wanted})
        limits = limits & F.col(name).isin(numbers)
        if numbers:
            limits = limits & F.col(name).between(numbers[0], numbers[-1])
    return tiles.where(limits)
