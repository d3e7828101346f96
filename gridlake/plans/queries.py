"""Every operator as a query over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.calendar import (
    TimeUnit,
    month_of,
    register_calendar_functions,
    resolve_calendar,
    year_between,
    year_bounds,
    year_of,
)
from gridlake.functions.layout import grid_partition_id, partition_grid, partition_layout
from gridlake.grid import BlockGrid, Grid, int_div, num_blocks
from gridlake.operators.blocks import densify, to_blocks, to_cells
from gridlake.operators.combine import add, combine, diff, subtract
from gridlake.operators.elementwise import map_cells, map_values, scalar_add, scalar_multiply, transpose
from gridlake.operators.lookup import lookup
from gridlake.operators.product import multiply, stack_blocks, sum_blocks
from gridlake.operators.ranges import differing_ranges
from gridlake.operators.regrid import interpolate, regrid_bilinear
from gridlake.operators.shape import (
    block_info,
    dims,
    duplicate_blocks,
    size_estimate_mb,
    violations,
)
from gridlake.operators.stats import checksum, count_zeros, period_stats, total_checksum
from gridlake.operators.stencil import (
    Affine,
    Scalar,
    Square,
    identity_aligner,
    identity_mapper,
    map_stencil,
)
from gridlake.operators.windows import Box, window
from gridlake.plans.inputs import (
    part_lines,
    quantities,
    sales,
    scratch_path,
    shipping_times,
    supplier_lines,
    table,
    vectors,
)
from gridlake.sources.dataset import load_dataset, save_dataset
from gridlake.sources.layout import save_grid
from gridlake.sources.metadata import (
    Metadata,
    Variable,
    attributes_frame,
    metadata_frame,
    variable_info,
)
from gridlake.sources.netcdf import netcdf_metadata, read_netcdf, select_variable, write_netcdf
from gridlake.sources.zones import read_netcdf_between, zone_map

Query = Callable[[SparkSession, str], DataFrame]
TILE = (16, 64)  # rows and columns of a tile in these queries
EPOCH = "days since 1995-01-01"

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- calendars -----------------------------------------------------------------------------


def _monthly(calendar: str, units: str = EPOCH) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        unit = TimeUnit.parse(calendar, units)
        return period_stats(shipping_times(spark, sf_dir), unit, "t", "l_quantity")

    return run


for _calendar in ("noleap", "all_leap", "360_day", "proleptic_gregorian", "julian"):
    QUERIES[f"year_month_{_calendar}"] = _monthly(_calendar)
# Moved back so that the data spans the change from the Julian to the Gregorian calendar.
QUERIES["year_month_standard"] = _monthly("standard", "days since 1580-01-01")


@query
def year_stats_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = TimeUnit.parse("noleap", EPOCH)
    return period_stats(
        shipping_times(spark, sf_dir), unit, "t", "l_quantity", by=["l_returnflag"], monthly=False
    )


@query
def event_hours_360_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractional hours since a moment within a day."""
    unit = TimeUnit.parse("360_day", "hours since 2023-12-30 18:30:00")
    hours = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 3600000000D")
    events = table(spark, sf_dir, "events").select(hours.alias("t"))
    return events.groupBy(
        year_of("t", unit).alias("year"), month_of("t", unit).alias("month")
    ).agg(F.count(F.lit(1)).alias("events"))


@query
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = TimeUnit.parse("noleap", EPOCH)
    # Stored, so that the range reaches the Parquet reader.
    path = scratch_path(spark, "times")
    shipping_times(spark, sf_dir).write.parquet(path)
    times = spark.read.parquet(path).where(year_between("t", unit, 1996, 1997))
    return times.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("items"), F.min("t").alias("first"), F.max("t").alias("last")
    )


@query
def sql_calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = Metadata((Variable("t", EPOCH, ("row",), {"calendar": "360_day"}),))
    register_calendar_functions(spark, meta, "t", suffix="_ship")
    return spark.sql(
        "SELECT yearOf_ship(t) AS year, monthOf_ship(t) AS month, COUNT(*) AS items, "
        "SUM(l_quantity) AS quantity FROM {times} GROUP BY 1, 2",
        times=shipping_times(spark, sf_dir),
    )


# --- cells -----------------------------------------------------------------------------------


@query
def map_cells_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_cells(sales(spark, sf_dir), lambda i, j, v: v * 10 + i - j).df


@query
def map_values_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_values(sales(spark, sf_dir), lambda v: v * v).df


@query
def scalar_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_multiply(sales(spark, sf_dir), 2.5).df


@query
def scalar_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_add(sales(spark, sf_dir), 0.5).df


@query
def transpose_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transpose(sales(spark, sf_dir)).df


@query
def densify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(sales(spark, sf_dir)).df


@query
def densify_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(supplier_lines(spark, sf_dir, yearly=True)).df


@query
def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(quantities(spark, sf_dir))


@query
def size_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return size_estimate_mb(quantities(spark, sf_dir))


@query
def add_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(sales(spark, sf_dir, "A"), sales(spark, sf_dir, "rest")).df


@query
def subtract_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtract(sales(spark, sf_dir, "A"), sales(spark, sf_dir, "rest")).df


@query
def combine_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine(sales(spark, sf_dir, "A"), sales(spark, sf_dir, "rest"), F.greatest).df


@query
def combine_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not known to be free of repeats: grouped and checked instead of joined."""
    a = replace(sales(spark, sf_dir, "A"), unique=False)
    return combine(a, sales(spark, sf_dir, "rest"), lambda x, y: x * 2 - y).df


@query
def grids_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(sales(spark, sf_dir, "A"), sales(spark, sf_dir, "rest"))


def _corrected(spark: SparkSession, sf_dir: str) -> Grid:
    """Sales, with one piece more of each part that every fiftieth supplier sold."""
    return map_cells(sales(spark, sf_dir), lambda i, j, v: v + F.when(i % 50 == 7, 1.0).otherwise(0.0))


@query
def grids_diff_narrowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff(sales(spark, sf_dir), _corrected(spark, sf_dir), narrow=True)


@query
def ranges_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return differing_ranges(sales(spark, sf_dir), _corrected(spark, sf_dir), *TILE)


@query
def multiply_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiply(sales(spark, sf_dir), part_lines(spark, sf_dir)).df


@query
def multiply_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by suppliers; line items count singly, so repeats add up."""
    grid = quantities(spark, sf_dir)
    return multiply(grid, transpose(grid)).df


def _stored(spark: SparkSession, grid: Grid) -> Grid:
    """The grid from a table that is bucketed by position, in the shared folder."""
    name = f"grid_{uuid4().hex}"
    return save_grid(grid, name, spark.sparkContext.defaultParallelism, scratch_path(spark, name))


@query
def add_stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``add_cells``, of stored grids: their rows are not shuffled again."""
    return add(_stored(spark, sales(spark, sf_dir, "A")), _stored(spark, sales(spark, sf_dir, "rest"))).df


@query
def add_stored_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (_stored(spark, _tiles(spark, sf_dir, flag)) for flag in ("A", "rest"))
    return to_cells(add(a, b)).df


# --- blocks ----------------------------------------------------------------------------------


def _tiles(spark: SparkSession, sf_dir: str, flag: str | None = None) -> BlockGrid:
    return to_blocks(sales(spark, sf_dir, flag), *TILE)


@query
def to_blocks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent, total and a sum weighted by place, which depends on the order within a tile."""
    weighted = F.aggregate(
        F.transform("vals", lambda v, k: v * k), F.lit(0.0), lambda total, v: total + v
    )
    total = F.aggregate("vals", F.lit(0.0), lambda total, v: total + v)
    return _tiles(spark, sf_dir).df.select(
        "bi", "bj", "nr", "nc", F.size("vals").alias("size"), total.alias("total"), weighted.alias("weighted")
    )


@query
def to_blocks_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(_tiles(spark, sf_dir)).df


@query
def to_cells_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sales, with every second row of tiles left empty between them."""
    grid = sales(spark, sf_dir)
    apart = F.col("i") + int_div(F.col("i"), TILE[0]) * TILE[0]
    moved = grid.with_df(grid.df.withColumn("i", apart), nrows=None)
    return to_cells(to_blocks(moved, *TILE), dense=True).df


@query
def map_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(map_cells(_tiles(spark, sf_dir), lambda i, j, v: v * 10 + i - j)).df


@query
def transpose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(transpose(_tiles(spark, sf_dir))).df


@query
def add_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(add(_tiles(spark, sf_dir, "A"), _tiles(spark, sf_dir, "rest"))).df


@query
def subtract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _tiles(spark, sf_dir, "A"), _tiles(spark, sf_dir, "rest")
    return to_cells(subtract(replace(a, unique=False), b)).df


@query
def combine_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(combine(_tiles(spark, sf_dir, "A"), _tiles(spark, sf_dir, "rest"), F.greatest)).df


@query
def multiply_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = to_blocks(sales(spark, sf_dir), 64, 256)
    right = to_blocks(part_lines(spark, sf_dir), 256, 8)
    return to_cells(multiply(left, right)).df


@query
def multiply_blocks_transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = to_blocks(sales(spark, sf_dir), 64, 256)
    return to_cells(multiply(blocks, transpose(blocks))).df


def _two_flags(spark: SparkSession, sf_dir: str) -> BlockGrid:
    """Tiles of two return flags stacked: nearly every tile occurs twice."""
    a, b = _tiles(spark, sf_dir, "A"), _tiles(spark, sf_dir, "rest")
    return stack_blocks(a, b)


@query
def sum_duplicate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(sum_blocks(_two_flags(spark, sf_dir))).df


@query
def block_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_info(_tiles(spark, sf_dir))


@query
def block_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims(_tiles(spark, sf_dir))


@query
def repeated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_blocks(_two_flags(spark, sf_dir))


@query
def validate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked tiles, checked against one row and column too few and one tile row less high."""
    grid = _two_flags(spark, sf_dir)
    claimed = replace(grid, nrows=grid.nrows - 1, ncols=grid.ncols - 1, rows_per_block=TILE[0] - 1)
    return violations(claimed)


@query
def grid_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _tiles(spark, sf_dir)
    layout = partition_layout(grid, 12)
    return grid.df.select("bi", "bj", grid_partition_id(layout).alias("part"))


@query
def grid_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the blocks really are after repartitioning by the layout."""
    grid = _tiles(spark, sf_dir)
    placed = partition_grid(grid, partition_layout(grid, 12))
    return placed.df.select("bi", "bj", F.spark_partition_id().alias("part"))


# --- neighbourhoods --------------------------------------------------------------------------


@query
def stencil_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    size = (grid.nrows, grid.ncols)
    return map_stencil(grid, Scalar(), size, identity_aligner, identity_mapper).df


@query
def stencil_square_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    size = (grid.nrows, grid.ncols)
    # Windows go over the edge by repeating the cell with the opposite sign.
    return map_stencil(
        grid,
        Square(lambda here: -here),
        size,
        identity_aligner,
        lambda w: w.here + w.next_row * 2 + w.next_col * 4 + w.diag * 8,
    ).df


@query
def stencil_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest of every second 2 x 2 window, of a sparse grid: absent cells count as zeros."""
    grid = sales(spark, sf_dir)
    return map_stencil(
        grid,
        Square(),
        (num_blocks(grid.nrows, 2), num_blocks(grid.ncols, 2)),
        Affine((2, 0, 1), (2, 0, 1)),
        lambda w: F.greatest(w.here, w.next_row, w.next_col, w.diag),
    ).df


@query
def stencil_pooling_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stencil_pooling``, without the windows that have no sales."""
    grid = sales(spark, sf_dir)
    return map_stencil(
        grid,
        Square(),
        (num_blocks(grid.nrows, 2), num_blocks(grid.ncols, 2)),
        Affine((2, 0, 1), (2, 0, 1)),
        lambda w: F.greatest(w.here, w.next_row, w.next_col, w.diag),
        dense=False,
    ).df


@query
def stencil_repeated_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row three times and every two of three columns' places twice, for each year."""
    grid = supplier_lines(spark, sf_dir, yearly=True)
    size = (3 * grid.nrows, 3 * grid.ncols // 2)
    return map_stencil(grid, Scalar(), size, Affine((1, 0, 3), (2, 0, 3)), lambda w: w.here * 2 + w.i).df


@query
def stencil_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in reverse, by an aligner that is any function of the output position."""
    grid = part_lines(spark, sf_dir)
    size = (grid.nrows, grid.ncols)
    return map_stencil(
        grid, Square(lambda here: here * 0), size, lambda i, j: (size[0] - 1 - i, j), lambda w: w.here - w.next_row
    ).df


def _asked(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A position for each line item, by which sale or its neighbour is looked up."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").cast("bigint").alias("i"),
        F.pmod(F.col("l_partkey") + F.col("l_linenumber") % 2, F.lit(grid.ncols)).cast("bigint").alias("j"),
    )


@query
def lookup_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = sales(spark, sf_dir)
    return lookup(grid, _asked(spark, sf_dir, grid))


@query
def lookup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``lookup_cells``, from tiles of a stored layout."""
    grid = _stored(spark, _tiles(spark, sf_dir))
    return lookup(grid, _asked(spark, sf_dir, grid))


@query
def stencil_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stencil_square_sum``, of tiles that exchange their edges."""
    grid = to_blocks(vectors(spark, sf_dir), 48, 24)
    return to_cells(
        map_stencil(
            grid,
            Square(lambda here: -here),
            (grid.nrows, grid.ncols),
            identity_aligner,
            lambda w: w.here + w.next_row * 2 + w.next_col * 4 + w.diag * 8,
        )
    ).df


@query
def stencil_blocks_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest of each 2 x 2 window of tiles of sales; absent cells count as zeros."""
    grid = _tiles(spark, sf_dir)
    largest = lambda w: F.greatest(w.here, w.next_row, w.next_col, w.diag)
    return to_cells(map_stencil(grid, Square(), (grid.nrows, grid.ncols), identity_aligner, largest)).df


@query
def window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window(part_lines(spark, sf_dir), Box(40, 3), "mean").df


@query
def window_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window(part_lines(spark, sf_dir), Box(25, 2), "max").df


@query
def window_sum_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_cells(window(_tiles(spark, sf_dir), Box(9, 33), "sum")).df


@query
def window_max_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows larger than the tiles, of one row of tiles for each line number."""
    grid = to_blocks(transpose(part_lines(spark, sf_dir)), 2, 16)
    return to_cells(window(grid, Box(3, 40), "max")).df


@query
def regrid_finer(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = vectors(spark, sf_dir)
    return regrid_bilinear(grid, (2 * grid.nrows - 1, 2 * grid.ncols - 1)).df


@query
def regrid_coarser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output column lies on a source column or half-way between two."""
    grid = vectors(spark, sf_dir)
    return regrid_bilinear(grid, (grid.nrows, (grid.ncols - 1) * 2 // 3 + 1)).df


@query
def regrid_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = supplier_lines(spark, sf_dir, yearly=True)
    return regrid_bilinear(grid, (2 * grid.nrows - 1, 2 * grid.ncols - 1)).df


def _vector_tiles(spark: SparkSession, sf_dir: str) -> BlockGrid:
    return to_blocks(vectors(spark, sf_dir), *TILE)


@query
def regrid_blocks_finer(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _vector_tiles(spark, sf_dir)
    return to_cells(regrid_bilinear(grid, (2 * grid.nrows - 1, 2 * grid.ncols - 1))).df


@query
def regrid_blocks_coarser(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _vector_tiles(spark, sf_dir)
    return to_cells(regrid_bilinear(grid, (grid.nrows, (grid.ncols - 1) * 2 // 3 + 1))).df


@query
def interpolate_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = supplier_lines(spark, sf_dir)
    size = max(grid.nrows, grid.ncols)
    square = replace(grid, nrows=size, ncols=size)
    return interpolate(square, (2 * size - 1, 2 * size - 1)).df


# --- summaries, files and metadata ---------------------------------------------------------------


@query
def zeros_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_zeros(table(spark, sf_dir, "lineitem"), "l_discount", by="l_returnflag")


@query
def checksum_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksum(table(spark, sf_dir, "lineitem"), "l_quantity", by="l_suppkey")


@query
def checksum_of_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose sum is negative are left out."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") - 25.5).alias("balance")
    )
    return total_checksum(items, "balance", by="l_suppkey")


def _array_files(spark: SparkSession, sf_dir: str) -> str:
    """The line items as array files in the shared folder."""
    path = scratch_path(spark, "arrays")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").cast("smallint").alias("line"),
        F.col("l_quantity").cast("int").alias("values"),
        F.round(F.col("l_discount") * 100).cast("int").alias("percent"),
        F.col("l_extendedprice").alias("price"),
    )
    write_netcdf(items, path, max_rows=1 << 20)
    return path


@query
def netcdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read_netcdf(spark, _array_files(spark, sf_dir))
    return cells.groupBy("line").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("values").alias("quantity"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


@query
def netcdf_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_netcdf(spark, _array_files(spark, sf_dir), ["percent"])
    return count_zeros(select_variable(files, "percent")).agg(F.sum("zeros").alias("zeros"))


@query
def netcdf_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_netcdf(spark, _array_files(spark, sf_dir), ["values"])
    return total_checksum(files, "values").select("count", "sum")


@query
def netcdf_period_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statistics of array files whose time axis brings its units and its calendar."""
    path = scratch_path(spark, "axis")
    times = shipping_times(spark, sf_dir).select(F.col("t").alias("time"), "l_quantity")
    axis = {"time": {"units": EPOCH, "calendar": "noleap"}, "l_quantity": {"_FillValue": -1.0}}
    write_netcdf(times, path, dim="time", attributes=axis)
    cells = read_netcdf(spark, path, ["l_quantity"], decode=True, coordinates=True)
    return period_stats(cells, resolve_calendar(netcdf_metadata(spark, path), "time"), "time", "l_quantity")


@query
def netcdf_year_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly statistics of two years of array files, of which a zone map says which ranges to read."""
    path = scratch_path(spark, "axis")
    times = shipping_times(spark, sf_dir).select(F.col("t").alias("time"), "l_quantity")
    write_netcdf(times.repartitionByRange(8, "time").sortWithinPartitions("time"), path, dim="time", attributes={"time": {"units": EPOCH, "calendar": "noleap"}})
    zones = zone_map(spark, path, "time", step=4096)
    stored = scratch_path(spark, "zones")
    zones.write.parquet(stored)
    unit = resolve_calendar(netcdf_metadata(spark, path), "time")
    cells = read_netcdf_between(spark, path, spark.read.parquet(stored), "time", *year_bounds(unit, 1996, 1997), ["l_quantity"])
    return period_stats(cells.where(year_between("time", unit, 1996, 1997)), unit, "time", "l_quantity")


@query
def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals saved with their calendar, loaded again and summed by month."""
    path = scratch_path(spark, "dataset")
    daily = shipping_times(spark, sf_dir).groupBy("t").agg(F.sum("l_quantity").alias("quantity"))
    meta = Metadata((Variable("t", EPOCH, ("t",), {"calendar": "noleap"}),))
    save_dataset(daily, meta, path)
    loaded, df = load_dataset(spark, path)
    return period_stats(df, resolve_calendar(loaded, "t"), "t", "quantity")


def _metadata_of_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with one variable per return flag, written as JSON and read back."""
    path = scratch_path(spark, "metadata")
    flags = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first"),
        F.count(F.lit(1)).cast("string").alias("items"),
    )
    variable = F.struct(
        F.col("l_returnflag").alias("name"),
        F.concat(F.lit("days since "), F.col("first")).alias("units"),
        F.array(F.lit("row")).alias("dims"),
        F.create_map(F.lit("calendar"), F.lit("noleap"), F.lit("items"), F.col("items")).alias("attributes"),
    )
    flags.agg(F.collect_list(variable).alias("variables")).coalesce(1).write.json(path)
    return metadata_frame(spark, path)


@query
def metadata_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variable_info(_metadata_of_flags(spark, sf_dir), "A")


@query
def metadata_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributes_frame(_metadata_of_flags(spark, sf_dir))
