import numpy as np
import pytest
from grids import GRID81, blocks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlake.functions.layout import (
    GridLayout,
    grid_partition_id,
    partition_grid,
    partition_layout,
    suggest_layout,
)
from gridlake.operators.local import to_local


def test_neighbours_share_a_partition(spark):
    grid = blocks(spark, np.ones((12, 10)), 2, 2)
    layout = GridLayout(6, 5, 2, 3)
    assert (layout.row_parts, layout.col_parts, layout.num_partitions) == (3, 2, 6)
    ids = grid.df.select("bi", "bj", grid_partition_id(layout).alias("id")).collect()
    assert all(r.id == r.bi // 2 + r.bj // 3 * 3 for r in ids)
    placed = partition_grid(grid, layout)
    assert placed.df.rdd.getNumPartitions() == 6
    where = placed.df.select("bi", "bj", F.spark_partition_id().alias("id")).collect()
    assert sorted(map(tuple, where)) == sorted(map(tuple, ids))
    assert np.array_equal(to_local(placed), np.ones((12, 10)))


@pytest.mark.parametrize(
    ("rows", "cols", "partitions", "sides"),
    [(10, 10, 4, (5, 5)), (3, 3, 100, (1, 1)), (9, 5, 8, (3, 2)), (7, 1000, 1, (7, 1000))],
)
def test_suggested_layout(rows, cols, partitions, sides):
    layout = suggest_layout(rows, cols, partitions)
    assert (layout.rows_per_part, layout.cols_per_part) == sides


def test_layout_of_a_grid(spark):
    grid = blocks(spark, GRID81)
    assert partition_layout(grid, 9) == GridLayout(3, 3, 1, 1)
    assert partition_layout(grid) == suggest_layout(3, 3, 8)


def test_bad_layouts(spark):
    with pytest.raises(ValueError):
        GridLayout(3, 0, 1, 1)
    with pytest.raises(ValueError):
        suggest_layout(3, 3, 0)
    grid = blocks(spark, GRID81)
    with pytest.raises(PySparkException, match="outside the layout"):
        grid.df.select(grid_partition_id(GridLayout(2, 3, 1, 1))).collect()
