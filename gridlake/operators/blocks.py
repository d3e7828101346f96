"""Moving between cells and blocks, and filling absent positions with zeros."""

from __future__ import annotations

from collections.abc import Callable
from functools import singledispatch
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.grid import (
    BLOCK_SCHEMA,
    BlockGrid,
    CellGrid,
    Grid,
    block_index,
    global_index,
    int_div,
    num_blocks,
    offset_in_block,
)
from gridlake.operators.shape import at_position, fail_if, unique_positions, with_dims

SEGMENT = 4096  # cells that densify fills from one marker row
CELLS_PER_TASK = 1 << 19
TASKS_PER_CORE = 16


def cells_from_rows(spark: SparkSession, rows) -> CellGrid:
    """A dense grid from a small local list of rows (tests and examples)."""
    rows = [list(map(float, row)) for row in rows]
    cells = [(i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)]
    df = spark.createDataFrame(cells, "i BIGINT, j BIGINT, v DOUBLE")
    return CellGrid(df, len(rows), len(rows[0]) if rows else 0, unique=True, dense=True)


def blocks_from_rows(
    spark: SparkSession,
    rows,
    rows_per_block: int,
    cols_per_block: int,
    nrows: int | None = None,
    ncols: int | None = None,
) -> BlockGrid:
    """A block grid from local ``(bi, bj, nr, nc, vals)`` tuples (tests and examples)."""
    df = spark.createDataFrame(list(rows), BLOCK_SCHEMA)
    return BlockGrid(df, rows_per_block, cols_per_block, nrows, ncols)


def most_tasks(spark: SparkSession) -> int:
    """Some tasks for each core, or Spark's number of shuffle partitions if that is larger."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tasks_for(grid: Grid, cells: int) -> int:
    """How many tasks to ask for when at most ``cells`` cells are made for each batch of a grid.

    The cells of the claimed size say little about those that a sparse grid makes, so beyond ``most_tasks``
    tasks get longer, not more. They stream what they make. With batch keys, where few tasks would do, this
    runs a job that counts the batches.
    """
    most = most_tasks(grid.df.sparkSession)
    if ceil(cells / CELLS_PER_TASK) >= most:
        return most
    batches = grid.df.select(*grid.keys).distinct().count() if grid.keys else 1
    return max(1, min(ceil(batches * cells / CELLS_PER_TASK), most))


def to_blocks(grid: CellGrid, rows_per_block: int, cols_per_block: int) -> BlockGrid:
    """Cut a cell grid into tiles; cells missing from a tile become zeros.

    One shuffle on the tile position. A group holds at most one tile, because repeated cells
    are rejected by an aggregate beforehand unless the grid is known to have none.
    """
    if rows_per_block <= 0 or cols_per_block <= 0:
        raise ValueError(f"tile sizes must be positive: {rows_per_block} x {cols_per_block}")
    grid = unique_positions(with_dims(grid))
    bi, bj = block_index("i", rows_per_block), block_index("j", cols_per_block)
    nr = _extent("bi", rows_per_block, grid.nrows)
    nc = _extent("bj", cols_per_block, grid.ncols)
    outside = (
        (F.col("i") < 0)
        | (F.col("j") < 0)
        | (F.col("i") >= F.lit(grid.nrows))
        | (F.col("j") >= F.lit(grid.ncols))
    )
    row, col = offset_in_block("i", rows_per_block), offset_in_block("j", cols_per_block)
    k = fail_if(outside, at_position("cell outside the claimed size:", "i", "j"), col * nr + row)
    located = grid.df.withColumns({"bi": bi, "bj": bj}).select(
        *grid.keys, "bi", "bj", k.cast("int").alias("k"), "v"
    )
    # Zeros are filled in after the shuffle: ask for tasks by the number of cells to be made.
    tasks = tasks_for(grid, grid.nrows * grid.ncols)
    packed = (
        located.repartition(tasks, *grid.keys, "bi", "bj")
        .groupBy(*grid.keys, "bi", "bj")
        .agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("cells"))
        .withColumns({"nr": nr, "nc": nc})
    )
    df = packed.select(*grid.keys, "bi", "bj", "nr", "nc", unpacked(*map(F.col, ("cells", "nr", "nc"))).alias("vals"))
    return BlockGrid(
        df,
        rows_per_block,
        cols_per_block,
        grid.nrows,
        grid.ncols,
        grid.keys,
        unique=True,
        dense=grid.dense,
        packed=None if grid.dense else (df, packed.select(*grid.keys, "bi", "bj", "nr", "nc", "cells"), None),
    )


def unpacked(cells: Column, nr: Column, nc: Column) -> Column:
    """Values of a tile from the sorted array ``cells`` of ``(k, v)``, absent ones as zeros."""
    zeros = F.array_repeat(F.lit(0.0), nr * nc)
    return F.when(F.size(cells) == nr * nc, cells["v"]).when(F.size(cells) == 0, zeros).otherwise(_fill_gaps(cells, nr * nc))


def _extent(index: str, size: int, total: int) -> Column:
    """Rows or columns of a tile; the last tile may be smaller."""
    return F.least(F.lit(size), F.lit(total) - F.col(index) * F.lit(size)).cast("int")


def _fill_gaps(cells: Column, length: Column) -> Column:
    """Values of the sorted array ``cells`` of ``(k, v)``, with a zero at each absent ``k``."""
    after = F.concat(F.slice(cells["k"], F.lit(2), F.size(cells)), F.array(length.cast("int")))
    runs = F.zip_with(
        cells,
        after,
        lambda cell, end: F.concat(
            F.array(cell["v"]), F.array_repeat(F.lit(0.0), end - cell["k"] - 1)
        ),
    )
    lead = F.array_repeat(F.lit(0.0), cells[0]["k"])
    return F.concat(lead, F.flatten(runs))


def to_cells(grid: BlockGrid, dense: bool = False) -> CellGrid:
    """Every cell of every block, explicit zeros included; narrow, no shuffle.

    With ``dense`` the cells of absent blocks are included as zeros. Of tiles that are at hand as their cells,
    no array of all values is made: each cell also emits those up to the next one.
    """
    if dense:
        grid = densify(grid)
    if grid.parts() is not None:
        return _cells_of_parts(grid)
    # Not posexplode: for that, Spark adds a test of the array's size, which would compute the
    # values of a derived block a second time.
    at = grid.df.select(*grid.position, "nr", F.posexplode_outer("vals").alias("k", "v"))
    at = at.where(F.col("k").isNotNull())
    i = global_index("bi", F.pmod("k", "nr"), grid.rows_per_block)
    j = global_index("bj", int_div(F.col("k"), F.col("nr")), grid.cols_per_block)
    return CellGrid(
        at.select(*grid.keys, i.alias("i"), j.alias("j"), "v"),
        grid.nrows,
        grid.ncols,
        grid.keys,
        unique=grid.unique,
        dense=grid.dense,
    )


def _cells_of_parts(grid: BlockGrid) -> CellGrid:
    """``to_cells`` of tiles that are at hand as their cells."""
    tiles, fill = grid.parts()
    k, size = F.col("cells.k"), F.col("nr") * F.col("nc")
    spans = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), k).alias("k"),
        F.concat(k, F.array(size)).alias("end"),
        F.concat(F.array(F.lit(None).cast("double")), F.col("cells.v")).alias("v"),
    )
    # Not explode: Spark would add a test of the arrays' sizes, and compute them a second time for it.
    spans = tiles.select(*grid.position, "nr", F.explode_outer(spans).alias("span")).select(*grid.position, "nr", "span.*")
    start = F.greatest(F.col("k"), F.lit(0))
    filled = spans.where(F.col("k").isNotNull() & (F.col("end") > start)).withColumn(
        "at", F.explode_outer(F.sequence(start, F.col("end") - 1))
    )
    i = global_index("bi", F.pmod("at", "nr"), grid.rows_per_block)
    j = global_index("bj", int_div(F.col("at"), F.col("nr")), grid.cols_per_block)
    placed = filled.select(*grid.keys, i.alias("i"), j.alias("j"), (F.col("at") == F.col("k")).alias("present"), "v")
    absent = F.lit(0.0) if fill is None else fill(F.col("i"), F.col("j"))
    return CellGrid(
        placed.select(*grid.keys, "i", "j", F.when(F.col("present"), F.col("v")).otherwise(absent).alias("v")),
        grid.nrows,
        grid.ncols,
        grid.keys,
        unique=grid.unique,
        dense=grid.dense,
    )


def index_rows(df: DataFrame, count: int, name: str, chunk: int = 4096) -> DataFrame:
    """Each row of ``df`` once per ``0 <= name < count``, without long arrays in any row."""
    chunks = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(ceil(count / chunk) - 1))))
    first = F.col("_chunk").cast("bigint") * chunk
    last = F.least(first + F.lit(chunk), F.lit(count)) - 1
    return chunks.withColumn(name, F.explode(F.sequence(first, last))).drop("_chunk")


@singledispatch
def densify(grid):
    """Every cell, or block, of the claimed size, with zeros where none is present."""
    raise TypeError(f"not a grid: {type(grid).__name__}")


@densify.register
def _(grid: BlockGrid) -> BlockGrid:
    """Absent blocks come from a join of all block positions with the blocks present.

    Blocks that were just made by ``to_blocks`` are already partitioned for it, and are joined as their cells.
    """
    if grid.dense:
        return grid
    grid = unique_positions(with_dims(grid))
    rows, cols = block_counts(grid)
    places = _every_place(grid, rows * cols, "at").select(
        *grid.keys,
        int_div(F.col("at"), max(cols, 1)).cast("int").alias("bi"),
        F.pmod("at", F.lit(max(cols, 1))).cast("int").alias("bj"),
    )
    nr = F.coalesce("nr", _extent("bi", grid.rows_per_block, grid.nrows))
    nc = F.coalesce("nc", _extent("bj", grid.cols_per_block, grid.ncols))
    tiles = grid.sparse()
    if tiles is not None:
        cells = F.coalesce("cells", F.array().cast("array<struct<k: int, v: double>>"))
        tiles = places.join(tiles, grid.position, "left").select(
            *grid.position, nr.alias("nr"), nc.alias("nc"), cells.alias("cells")
        )
        vals = unpacked(*map(F.col, ("cells", "nr", "nc")))
        df = tiles.select(*grid.position, "nr", "nc", vals.alias("vals"))
        return grid.with_df(df, dense=True, packed=(df, tiles, None))
    df = places.join(grid.df, grid.position, "left").select(
        *grid.position,
        nr.alias("nr"),
        nc.alias("nc"),
        F.coalesce("vals", F.array_repeat(F.lit(0.0), nr * nc)).alias("vals"),
    )
    return grid.with_df(df, dense=True)


def _every_place(grid: Grid, count: int, name: str) -> DataFrame:
    """``0 <= name < count``, for each batch of a grid that has batch keys."""
    if grid.keys:
        return index_rows(grid.df.select(*grid.keys).distinct(), count, name)
    return grid.df.sparkSession.range(count).withColumnRenamed("id", name)


@densify.register
def _(grid: CellGrid) -> CellGrid:
    return fill_absent(grid, lambda i, j: F.lit(0.0))


def fill_absent(grid: CellGrid, fill: Callable[[Column, Column], Column]) -> CellGrid:
    """Every cell of the claimed size, with ``fill(i, j)`` where none is present.

    One shuffle of the cells present, never of those filled in. The grid is cut into segments of at most
    ``SEGMENT`` cells, about square, so that few indices repeat in what a task writes, and each segment gets one
    marker row. After a shuffle on the segment, every row also emits the cells up to the next row of its
    segment, row by row, so a task works through bounded segments in order.
    """
    if grid.dense:
        return grid
    grid = unique_positions(with_dims(grid))
    total = grid.nrows * grid.ncols
    if total == 0:
        return grid.with_df(grid.df.limit(0), dense=True)
    height, width = _segment_size(grid.nrows, grid.ncols)
    across = num_blocks(grid.ncols, width)
    segments = num_blocks(grid.nrows, height) * across
    inside = (
        (F.col("i") >= 0)
        & (F.col("j") >= 0)
        & (F.col("i") < F.lit(grid.nrows))
        & (F.col("j") < F.lit(grid.ncols))
    )
    segment = fail_if(
        ~inside,
        at_position("cell outside the claimed size:", "i", "j"),
        int_div(F.col("i"), height) * F.lit(across) + int_div(F.col("j"), width),
    )

    def reach(begin: Column, size: int, total: int) -> Column:
        return F.least(F.lit(size), F.lit(total) - begin).cast("int")

    left = int_div(F.col("j"), width) * F.lit(width)
    k = F.pmod("i", F.lit(height)) * reach(left, width, grid.ncols) + F.pmod("j", F.lit(width))
    cells = grid.df.select(*grid.keys, segment.alias("segment"), k.cast("int").alias("k"), "v")
    markers = _every_place(grid, segments, "segment").select(*grid.keys, "segment", F.lit(-1).alias("k"), F.lit(0.0).alias("v"))

    # The zeros appear after the shuffle, so its size says nothing about the work per task:
    # ask for tasks by the number of cells to be written.
    by_segment = [*grid.keys, "segment"]
    rows = cells.unionByName(markers).repartition(tasks_for(grid, total), *by_segment)
    following = F.expr(
        f"lead(k) OVER (PARTITION BY {', '.join(f'`{c}`' for c in by_segment)} ORDER BY k)"
    )
    top, left = int_div(F.col("segment"), across) * F.lit(height), F.pmod("segment", F.lit(across)) * F.lit(width)
    length = reach(top, height, grid.nrows) * reach(left, width, grid.ncols)
    length = F.when(F.col("segment").isNull(), F.lit(SEGMENT)).otherwise(length)
    start = F.greatest(F.col("k"), F.lit(0))
    spans = (
        rows.withColumn("end", F.coalesce(following, length))
        .where(F.col("end") > start)
        .select(*grid.keys, "k", "end", "v", top.alias("x"), left.alias("y"), reach(left, width, grid.ncols).alias("step"))
    )
    # Not explode: Spark would add a test of the array's size, and compute it a second time for it.
    filled = spans.withColumn("at", F.explode_outer(F.sequence(start, F.col("end") - 1)))
    df = filled.select(
        *grid.keys,
        (F.col("x") + int_div(F.col("at"), F.col("step"))).alias("i"),
        (F.col("y") + F.pmod("at", "step")).cast("bigint").alias("j"),
        (F.col("at") == F.col("k")).alias("present"),
        "v",
    )
    v = F.when(F.col("present"), F.col("v")).otherwise(fill(F.col("i"), F.col("j")))
    return grid.with_df(df.select(*grid.position, v.alias("v")), dense=True)


def _segment_size(nrows: int, ncols: int) -> tuple[int, int]:
    """Rows and columns of a segment of at most ``SEGMENT`` cells, a square or as long as a narrow grid has it."""
    cols = min(ncols, isqrt(SEGMENT))
    rows = min(nrows, SEGMENT // cols)
    return rows, min(ncols, SEGMENT // rows)


def block_counts(grid: BlockGrid) -> tuple[int, int]:
    """Number of block rows and block columns of a grid of known size."""
    grid = with_dims(grid)
    return num_blocks(grid.nrows, grid.rows_per_block), num_blocks(grid.ncols, grid.cols_per_block)
