"""Grids used by several tests."""

import numpy as np

from gridlake.grid import BlockGrid
from gridlake.operators.blocks import blocks_from_rows, cells_from_rows

MAT9 = np.arange(1.0, 10).reshape((3, 3), order="F")
GRID81 = np.block([[MAT9 + 9 * (3 * r + c) for c in range(3)] for r in range(3)])


def block_rows(array: np.ndarray, rows: int, cols: int, skip=()) -> list[tuple]:
    out = []
    for bi, i in enumerate(range(0, array.shape[0], rows)):
        for bj, j in enumerate(range(0, array.shape[1], cols)):
            tile = array[i : i + rows, j : j + cols]
            if (bi, bj) not in skip:
                out.append((bi, bj, *tile.shape, tile.reshape(-1, order="F").tolist()))
    return out


def blocks(spark, array, rows=3, cols=3, skip=(), **sizes) -> BlockGrid:
    array = np.asarray(array, dtype=float)
    sizes = sizes or {"nrows": array.shape[0], "ncols": array.shape[1]}
    return blocks_from_rows(spark, block_rows(array, rows, cols, skip), rows, cols, **sizes)


def sparse_cells(spark, array):
    """Cells of the non-zero values only."""
    grid = cells_from_rows(spark, array)
    return grid.with_df(grid.df.where("v != 0"), dense=False)
