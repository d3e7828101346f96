"""Resampling of tiles."""

import numpy as np
import pytest
from grids import blocks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_stencils import bilinear

from gridlake.grid import BlockGrid, CellGrid
from gridlake.operators.blocks import blocks_from_rows, to_blocks, to_cells
from gridlake.operators.local import to_local
from gridlake.operators.regrid import interpolate, regrid_bilinear
from gridlake.operators.regrid_tiles import Axis
from gridlake.operators.shape import validate

RNG = np.random.default_rng(23)


@pytest.mark.parametrize("shape", [(3, 5), (7, 4), (1, 6), (8, 1), (20, 3)])
@pytest.mark.parametrize("target", [(9, 11), (2, 2), (3, 8), (23, 2), (40, 3)])
def test_matches_the_definition(spark, shape, target):
    array = RNG.random(shape)
    grid = regrid_bilinear(blocks(spark, array, 3, 2), target)
    assert isinstance(grid, BlockGrid)
    validate(grid, values=True)
    assert np.allclose(to_local(grid), bilinear(array, *target), atol=1e-12)


def test_axes_agree_with_what_outputs_look_at():
    for n, t, size in ((1, 9, 2), (2, 9, 3), (9, 2, 3), (30, 7, 4), (7, 30, 4), (12, 12, 5), (100, 2, 3)):
        axis = Axis(n, t, size)
        looked = {}
        for out in range(t):
            at = out * (n - 1) / (t - 1)
            for source in {int(np.floor(at + 1e-9)), int(np.ceil(at - 1e-9))}:
                looked.setdefault(source // size, set()).add(out // size)
        for tile in range(-(-n // size)):
            assert set(axis.outputs(tile)) == looked.get(tile, set())


@pytest.mark.parametrize("target", [(19, 25), (5, 4), (10, 13)])
def test_absent_tiles(spark, target):
    array = RNG.random((10, 13))
    skip = {(0, 0), (1, 1), (3, 3), (2, 0)}
    for bi, bj in skip:
        array[bi * 3 : bi * 3 + 3, bj * 4 : bj * 4 + 4] = 0
    grid = blocks(spark, array, 3, 4, skip)
    out = regrid_bilinear(grid, target)
    assert np.allclose(to_local(out), bilinear(array, *target))
    # Where cells give an output, so do tiles.
    cells = {(r.i, r.j) for r in regrid_bilinear(to_cells(grid), target).df.collect()}
    assert cells <= {(r.i, r.j) for r in to_cells(out).df.collect()}
    one = blocks(spark, array, 3, 4, {(b, c) for b in range(4) for c in range(4)} - {(1, 2)})
    assert {(r.bi, r.bj) for r in regrid_bilinear(one, (10, 13)).df.collect()} == {(1, 2)}


def test_nothing_present(spark):
    grid = blocks_from_rows(spark, [], 3, 4, 10, 13)
    assert regrid_bilinear(grid, (5, 30)).df.count() == 0
    with pytest.raises(ValueError, match="empty"):
        regrid_bilinear(blocks_from_rows(spark, [], 3, 4, 0, 0), (5, 30))
    with pytest.raises(ValueError, match="at least 2"):
        regrid_bilinear(grid, (1, 30))


def test_each_batch(spark):
    arrays = {t: RNG.random((5, 4)) for t in ("a", "b")}
    rows = [(t, i, j, float(a[i, j])) for t, a in arrays.items() for i in range(5) for j in range(4)]
    df = spark.createDataFrame(rows, "`the time` STRING, i BIGINT, j BIGINT, v DOUBLE")
    tiles = to_blocks(CellGrid(df, 5, 4, keys=("the time",)), 2, 3)
    out = regrid_bilinear(tiles, (8, 9))
    for t, array in arrays.items():
        one = out.df.where(F.col("the time") == t).drop("the time")
        assert np.allclose(to_local(BlockGrid(one, 2, 3, 8, 9)), bilinear(array, 8, 9))


def test_nan_without_weight_is_left_out(spark):
    array = np.ones((3, 3))
    array[2, 2] = np.nan
    array[0, 0] = np.inf
    for target in ((5, 5), (3, 2)):
        got = to_local(regrid_bilinear(blocks(spark, array, 2, 2), target))
        assert np.isnan(got[-1, -1]) and np.isinf(got[0, 0])
        assert not np.isnan(got[0]).any() and not np.isnan(got[:, 0]).any()


def test_interpolate_turns_tiles(spark):
    array = RNG.random((6, 6))
    assert np.allclose(to_local(interpolate(blocks(spark, array, 4, 3), (9, 12))), bilinear(array.T, 9, 12))


def test_damaged_tiles_fail(spark):
    good = (0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0])
    edge = (0, 1, 2, 1, [5.0, 6.0])
    for rows, message in (
        ([good, good, edge], "more than once"),
        ([(0, 0, 2, 1, [1.0, 2.0]), edge], "2 values as 2 x 1"),
        ([(0, 0, 2, 2, [1.0]), edge], "1 values as 2 x 2"),
        ([good, (0, 2, 2, 1, [5.0, 6.0])], "outside the claimed size"),
    ):
        with pytest.raises(PySparkException, match=message):
            regrid_bilinear(blocks_from_rows(spark, rows, 2, 2, 2, 3), (4, 4)).df.collect()


def test_no_row_for_each_cell_is_shuffled(spark):
    cells = spark.range(300 * 200).selectExpr("id div 200 i", "id % 200 j", "double(id % 7) v")
    tiles = to_blocks(CellGrid(cells, 300, 200, unique=True, dense=True), 50, 50)
    out = regrid_bilinear(tiles, (599, 399))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2  # to make the tiles, and to resample them
    want = regrid_bilinear(to_cells(tiles), (599, 399))
    pairs = to_cells(out).df.join(want.df.withColumnRenamed("v", "w"), ["i", "j"], "full")
    assert pairs.where("v <=> w").count() == pairs.count() == 599 * 399
