"""Known results for small grids."""

import numpy as np
import pytest
from grids import GRID81, MAT9, blocks

from gridlake.operators.blocks import cells_from_rows, to_blocks, to_cells
from gridlake.operators.combine import add, grids_equal, subtract
from gridlake.operators.elementwise import map_values, scalar_add, scalar_multiply, transpose
from gridlake.operators.local import to_local
from gridlake.operators.product import multiply
from gridlake.operators.regrid import interpolate, regrid_bilinear
from gridlake.operators.stencil import Scalar, identity_aligner, identity_mapper, map_stencil


def test_layout_is_column_major(spark):
    grid = to_local(blocks(spark, GRID81))
    assert grid[0].tolist() == [1, 4, 7, 10, 13, 16, 19, 22, 25]
    assert grid[3].tolist() == [28, 31, 34, 37, 40, 43, 46, 49, 52]
    assert grid[8].tolist() == [57, 60, 63, 66, 69, 72, 75, 78, 81]


def test_cutting_into_blocks_and_back(spark):
    again = to_blocks(to_cells(blocks(spark, GRID81)), 3, 3)
    assert np.array_equal(to_local(again), GRID81)
    first = again.df.where("bi = 0 AND bj = 0").first()
    assert first.vals == list(range(1, 10))


def test_transpose_add_subtract(spark):
    grid = blocks(spark, GRID81)
    turned = transpose(grid)
    assert to_local(turned)[0].tolist() == [1, 2, 3, 28, 29, 30, 55, 56, 57]
    assert to_local(add(grid, turned))[0].tolist() == [2, 6, 10, 38, 42, 46, 74, 78, 82]
    assert to_local(subtract(grid, turned))[8].tolist() == [32, 34, 36, 14, 16, 18, -4, -2, 0]


@pytest.mark.parametrize("as_cells", [False, True])
def test_product_with_transpose(spark, as_cells):
    grid = blocks(spark, GRID81)
    grid = to_cells(grid) if as_cells else grid
    product = to_local(multiply(grid, transpose(grid)))
    assert product[0].tolist() == [2061, 2178, 2295, 5220, 5337, 5454, 8379, 8496, 8613]
    assert product[8].tolist() == [8613, 9234, 9855, 25380, 26001, 26622, 42147, 42768, 43389]
    assert np.array_equal(product, GRID81 @ GRID81.T)


def test_product_of_one_block(spark):
    grid = to_blocks(cells_from_rows(spark, MAT9), 3, 3)
    product = to_local(multiply(grid, transpose(grid)))
    assert product.tolist() == [[66, 78, 90], [78, 93, 108], [90, 108, 126]]


def test_squares(spark):
    squares = map_values(blocks(spark, GRID81), lambda v: v * v)
    assert to_local(squares)[8].tolist() == [3249, 3600, 3969, 4356, 4761, 5184, 5625, 6084, 6561]


def test_scalars(spark):
    grid = cells_from_rows(spark, MAT9)
    assert np.array_equal(to_local(scalar_multiply(grid, 2)), MAT9 * 2)
    assert np.array_equal(to_local(scalar_add(grid, 9)), MAT9 + 9)
    few = grid.with_df(grid.df.where("v > 5"), dense=False)
    assert np.array_equal(to_local(scalar_add(few, 1)), np.where(MAT9 > 5, MAT9, 0) + 1)


def test_identity_stencil(spark):
    grid = cells_from_rows(spark, MAT9)
    same = map_stencil(grid, Scalar(), (3, 3), identity_aligner, identity_mapper)
    assert grids_equal(same, grid)


def test_interpolate_finer(spark):
    corner = cells_from_rows(spark, [[1, 0], [0, 0]])
    assert to_local(interpolate(corner, (3, 3))).tolist() == [[1, 0.5, 0], [0.5, 0.25, 0], [0, 0, 0]]
    finer = to_local(interpolate(cells_from_rows(spark, MAT9), (9, 9)))
    assert finer[0].tolist() == [1, 1.25, 1.5, 1.75, 2, 2.25, 2.5, 2.75, 3]
    assert finer[8].tolist() == [7, 7.25, 7.5, 7.75, 8, 8.25, 8.5, 8.75, 9]


def test_interpolate_coarser(spark):
    ramp = np.arange(1.0, 37).reshape((6, 6), order="F")
    coarser = to_local(interpolate(cells_from_rows(spark, ramp), (4, 4)))
    first = [1, 2.66667, 4.33333, 6]
    assert np.allclose(coarser, [[v + 10 * r for v in first] for r in range(4)], atol=5e-6)


def test_interpolate_needs_a_square(spark):
    grid = cells_from_rows(spark, np.ones((3, 5)))
    with pytest.raises(ValueError, match="square"):
        interpolate(grid, (4, 4))
    with pytest.raises(ValueError, match="at least 2"):
        regrid_bilinear(grid, (1, 4))
