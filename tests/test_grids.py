"""Semantics of the grid operators on random, sparse, ragged and broken input."""

import numpy as np
import pytest
from grids import GRID81, block_rows, blocks, sparse_cells
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import gridlake.operators.blocks as blocks_module
import gridlake.operators.product as product_module
from gridlake.grid import BlockGrid, CellGrid
from gridlake.operators.blocks import cells_from_rows, densify, index_rows, to_blocks, to_cells
from gridlake.operators.combine import add, combine, diff, grids_equal, subtract
from gridlake.operators.elementwise import map_cells, map_values, transpose
from gridlake.operators.local import to_local
from gridlake.operators.product import hot_inner_indices, multiply, sum_blocks
from gridlake.operators.shape import (
    block_info,
    dims,
    duplicate_blocks,
    size_estimate_mb,
    validate,
    violations,
    with_dims,
)

RNG = np.random.default_rng(7)


def random_grid(rows, cols, filled=1.0):
    values = RNG.integers(1, 20, (rows, cols)).astype(float)
    return np.where(RNG.random((rows, cols)) < filled, values, 0.0)


# --- encodings -------------------------------------------------------------------------------


@pytest.mark.parametrize(("rows", "cols"), [(3, 3), (7, 5), (1, 4), (4, 1), (10, 10)])
def test_ragged_tiles(spark, rows, cols):
    array = random_grid(7, 5)
    tiles = to_blocks(cells_from_rows(spark, array), rows, cols)
    assert np.array_equal(to_local(tiles), array)
    validate(tiles)
    sparse = random_grid(7, 5, 0.3)
    tiles = to_blocks(sparse_cells(spark, sparse), rows, cols)
    assert np.array_equal(to_local(tiles), sparse)
    validate(tiles)
    turned = transpose(tiles)
    assert np.array_equal(to_local(turned), sparse.T)
    validate(turned)


def test_absent_blocks(spark):
    skip = [(0, 2), (2, 0)]
    grid = blocks(spark, GRID81, skip=skip)
    expected = GRID81.copy()
    expected[0:3, 6:9] = expected[6:9, 0:3] = 0
    assert np.array_equal(to_local(grid), expected)
    assert to_cells(grid).df.count() == 63
    full = to_cells(grid, dense=True)
    assert full.df.count() == 81 and np.array_equal(to_local(full), expected)
    # A map leaves absent blocks alone, even if it does not keep zero.
    assert to_local(map_values(grid, lambda v: v * 0 + 1)).sum() == 63


def test_maps_see_global_indices(spark):
    array = random_grid(7, 5)
    cells = cells_from_rows(spark, array)
    i, j = np.indices(array.shape)
    for grid in (cells, to_blocks(cells, 3, 2)):
        got = to_local(map_cells(grid, lambda i, j, v: v * 100 + i * 10 + j))
        assert np.array_equal(got, array * 100 + i * 10 + j)


def test_map_takes_a_pandas_udf(spark):
    @F.pandas_udf("double")
    def half(v):
        return v / 2

    array = random_grid(3, 4)
    assert np.array_equal(to_local(map_values(cells_from_rows(spark, array), half)), array / 2)


def test_densify_crosses_segments(spark, monkeypatch):
    monkeypatch.setattr(blocks_module, "SEGMENT", 7)
    monkeypatch.setattr(blocks_module, "CELLS_PER_TASK", 20)
    array = random_grid(13, 11, 0.1)
    full = densify(sparse_cells(spark, array))
    assert full.df.count() == 143 and np.array_equal(to_local(full), array)
    empty = CellGrid(spark.createDataFrame([], "i BIGINT, j BIGINT, v DOUBLE"), 5, 3)
    assert densify(empty).df.count() == 15


def test_densify_each_batch(spark):
    df = spark.createDataFrame([("x", 0, 1, 2.0), ("y", 1, 0, 3.0)], "key STRING, i BIGINT, j BIGINT, v DOUBLE")
    full = densify(CellGrid(df, 2, 2, keys=("key",)))
    rows = {(r.key, r.i, r.j): r.v for r in full.df.collect()}
    assert len(rows) == 8 and rows["x", 0, 1] == 2 and rows["y", 1, 0] == 3 and sum(rows.values()) == 5
    tiles = densify(to_blocks(CellGrid(df, 2, 2, keys=("key",)), 1, 1))
    assert tiles.df.count() == 8 and to_cells(tiles).df.agg(F.sum("v")).first()[0] == 5


def test_index_rows(spark):
    got = index_rows(spark.range(2), 10, "n", chunk=4)
    assert sorted((r.id, r.n) for r in got.collect()) == [(k, n) for k in (0, 1) for n in range(10)]


def test_sizes(spark):
    grid = blocks(spark, np.ones((7, 5)), nrows=None, ncols=None)
    assert tuple(dims(grid).first()) == (7, 5)
    assert tuple(dims(to_cells(grid)).first()) == (7, 5)
    known = with_dims(grid)
    assert (known.nrows, known.ncols) == (7, 5)
    with pytest.raises(ValueError, match="more than the claimed"):
        with_dims(blocks(spark, np.ones((7, 5)), nrows=6, ncols=5), check=True)
    cells = spark.createDataFrame([(4999, 4999, 1.0)], "i BIGINT, j BIGINT, v DOUBLE")
    assert size_estimate_mb(CellGrid(cells)).first().mb == 200


def test_block_info_reads_no_values(spark, tmp_path):
    path = str(tmp_path / "blocks")
    blocks(spark, GRID81).df.write.parquet(path)
    info = block_info(BlockGrid(spark.read.parquet(path), 3, 3, 9, 9))
    assert info.count() == 9
    assert "vals" not in info._jdf.queryExecution().executedPlan().toString()


# --- broken input ------------------------------------------------------------------------------


def test_violations(spark):
    rows = block_rows(GRID81, 3, 3)
    rows.append(rows[4])
    rows[0] = (0, 0, 2, 3, [1.0] * 6)
    grid = BlockGrid(
        spark.createDataFrame(rows, "bi INT, bj INT, nr INT, nc INT, vals ARRAY<DOUBLE>"), 3, 3, 9, 8
    )
    found = {(r.bi, r.bj, r.rule): r.detail for r in violations(grid).collect()}
    assert found == {
        (0, 0, "shape"): "is 2 3",
        (1, 1, "duplicate"): "2 copies",
        (0, 2, "size"): "reaches 3 9",
        (1, 2, "size"): "reaches 6 9",
        (2, 2, "size"): "reaches 9 9",
    }
    with pytest.raises(ValueError, match="size rule"):
        validate(grid)
    validate(blocks(spark, GRID81))
    assert [tuple(r) for r in duplicate_blocks(grid).collect()] == [(1, 1, 2)]


def _fails(grid, text):
    with pytest.raises(PySparkException, match=text):
        grid.df.collect()


def test_repeated_positions_fail(spark):
    good = blocks(spark, GRID81)
    bad = good.with_df(good.df.union(good.df.where("bi = 1 AND bj = 1")))
    _fails(add(bad, good), "block occurs more than once: bi=1 bj=1")
    _fails(subtract(good, bad), "block occurs more than once")
    _fails(densify(bad), "block occurs more than once")
    cells, twice = to_cells(good), to_cells(bad)
    _fails(add(cells, twice), "cell occurs more than once")
    _fails(densify(twice), "cell occurs more than once")
    _fails(to_blocks(twice, 2, 2), "cell occurs more than once")
    with pytest.raises(ValueError, match="more than once"):
        to_local(bad)
    # A product adds repeated blocks up.
    doubled = GRID81.copy()
    doubled[3:6, 3:6] *= 2
    assert np.array_equal(to_local(multiply(bad, good)), doubled @ GRID81)
    assert np.array_equal(to_local(multiply(good, bad)), GRID81 @ doubled)
    assert np.array_equal(to_local(multiply(twice, cells)), doubled @ GRID81)
    assert np.array_equal(to_local(sum_blocks(bad)), doubled)


def test_mismatches_raise(spark):
    a = cells_from_rows(spark, np.ones((3, 4)))
    with pytest.raises(ValueError, match="differ in size"):
        add(a, transpose(a))
    with pytest.raises(ValueError, match="inner sizes"):
        multiply(a, a)
    with pytest.raises(ValueError, match="tiles differ"):
        add(to_blocks(a, 2, 2), to_blocks(a, 3, 2))
    with pytest.raises(ValueError, match="tiles do not meet"):
        multiply(to_blocks(a, 2, 2), to_blocks(transpose(a), 3, 3))
    with pytest.raises(ValueError, match="positive"):
        to_blocks(a, 0, 2)
    _fails(to_blocks(a.with_df(a.df, nrows=2), 2, 2), "outside the claimed size")
    ragged = blocks(spark, np.ones((3, 4)), 2, 2)
    odd = ragged.with_df(
        ragged.df.withColumns({"nc": F.lit(1), "vals": F.slice("vals", F.lit(1), F.col("nr"))})
    )
    _fails(add(ragged, odd), "blocks differ in extent")


def test_local_size_limit(spark):
    cells = spark.createDataFrame([(0, 0, 1.0)], "i BIGINT, j BIGINT, v DOUBLE")
    with pytest.raises(ValueError, match="too large"):
        to_local(CellGrid(cells, 1 << 16, 1 << 15))


# --- two grids ---------------------------------------------------------------------------------


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("as_blocks", [False, True])
def test_combine_counts_absent_as_zero(spark, unique, as_blocks):
    a, b = random_grid(7, 5, 0.4), random_grid(7, 5, 0.4)
    a[:3, :3] = b[3:6, 3:] = 0  # a tile that only one of them has
    grids = [sparse_cells(spark, x) for x in (a, b)]
    if as_blocks:
        grids = [to_blocks(g, 3, 3) for g in grids]
    left, right = (g.with_df(g.df, unique=unique) for g in grids)
    assert np.array_equal(to_local(add(left, right)), a + b)
    assert np.array_equal(to_local(subtract(left, right)), a - b)
    # The product with an absent side is zero, not the side that is present.
    assert np.array_equal(to_local(combine(left, right, lambda x, y: x * y)), a * b)
    assert grids_equal(subtract(add(left, right), right), left)


def test_equality(spark):
    a = random_grid(4, 4, 0.5)
    grid, other = sparse_cells(spark, a), cells_from_rows(spark, a)
    assert grids_equal(grid, other)
    assert grids_equal(to_blocks(grid, 3, 3), other)
    near = map_cells(other, lambda i, j, v: v + F.when((i == 1) & (j == 2), 0.001).otherwise(0.0))
    assert not grids_equal(other, near)
    assert [(r.i, r.j) for r in diff(other, near).collect()] == [(1, 2)]
    assert grids_equal(other, near, tolerance=0.01)
    assert not grids_equal(other, cells_from_rows(spark, np.ones((4, 5))))
    nan = map_values(other, lambda v: F.lit(float("nan")))
    assert not grids_equal(nan, nan)


# --- products ------------------------------------------------------------------------------------


@pytest.mark.parametrize("filled", [1.0, 0.2])
@pytest.mark.parametrize("budget", [1e-5, 4e-4, 256])
def test_block_product(spark, filled, budget):
    a, b = random_grid(17, 25, filled), random_grid(25, 11, filled)
    if filled < 1:
        a[:, 8:16] = b[:8] = 0
    left, right = to_blocks(sparse_cells(spark, a), 3, 4), to_blocks(sparse_cells(spark, b), 4, 3)
    product = multiply(left, right, tile_budget_mb=budget)
    assert np.array_equal(to_local(product), a @ b)
    validate(product)
    turned = multiply(transpose(right), transpose(left), tile_budget_mb=budget)
    assert np.array_equal(to_local(turned), (a @ b).T)


def test_long_inner_axis_is_split(spark):
    a = random_grid(2, 200)
    left = to_blocks(cells_from_rows(spark, a), 2, 2)
    product = multiply(left, transpose(left))
    assert np.array_equal(to_local(product), a @ a.T)


def test_sum_in_steps(spark, monkeypatch):
    monkeypatch.setattr(product_module, "FAN_IN", 2)
    grid = blocks(spark, GRID81)
    many = grid.with_df(grid.df.union(grid.df).union(grid.df).repartition(6))
    assert np.array_equal(to_local(sum_blocks(many)), 3 * GRID81)


def test_hot_inner_index_is_split(spark, monkeypatch):
    a, b = random_grid(60, 40, 0.05), random_grid(40, 50, 0.05)
    a[:, 7], b[7] = 3, 2
    left, right = sparse_cells(spark, a), sparse_cells(spark, b)
    assert hot_inner_indices(left, right) == []
    monkeypatch.setattr(product_module, "TASK_PAIRS", 50)
    monkeypatch.setattr(product_module, "HOT_KEYS", 20)
    ((k, row_parts, col_parts),) = hot_inner_indices(left, right)
    assert k == 7 and row_parts > 1 and col_parts > 1
    assert np.array_equal(to_local(multiply(left, right)), a @ b)
    plain = multiply(left, right, split_hot=False)
    assert np.array_equal(to_local(plain), a @ b)


def test_nan_spreads_in_products(spark):
    a = np.eye(3)
    a[1, 1] = np.nan
    cells = cells_from_rows(spark, a)
    for grid in (cells, to_blocks(cells, 2, 2)):
        product = to_local(multiply(grid, grid))
        assert np.isnan(product[1]).all() and np.isnan(product[:, 1]).all()
        assert product[0, 0] == 1


def test_cell_operators_run_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "cells")
    array = random_grid(5, 4)
    cells_from_rows(spark, array).df.write.parquet(path)
    stream = spark.readStream.schema("i BIGINT, j BIGINT, v DOUBLE").parquet(path)
    turned = map_values(transpose(CellGrid(stream, 5, 4)), lambda v: v * 2)
    started = turned.df.writeStream.format("memory").queryName("turned").start()
    started.processAllAvailable()
    started.stop()
    assert np.array_equal(to_local(CellGrid(spark.table("turned"), 4, 5)), array.T * 2)
