"""Looking up positions of grids."""

from uuid import uuid4

import numpy as np
import pytest
from grids import blocks, sparse_cells
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlake.grid import CellGrid
from gridlake.operators.blocks import to_blocks
from gridlake.operators.lookup import MAX_NAMED, lookup
from gridlake.plans.inputs import scratch_path
from gridlake.sources.layout import save_grid

RNG = np.random.default_rng(9)
ARRAY = np.where(RNG.random((11, 13)) < 0.4, RNG.random((11, 13)), 0.0)


def test_any_positions(spark):
    rows = [(k, int(RNG.integers(11)), int(RNG.integers(13))) for k in range(300)]
    rows += [(300, None, 2), (301, 2, None), (302, 10, 12), (303, 10, 12)]
    asked = spark.createDataFrame(rows, "id int, i bigint, j bigint")
    want = [(k, i, j, None if i is None or j is None else ARRAY[i, j]) for k, i, j in rows]
    cells = sparse_cells(spark, ARRAY)
    # Tiles of which some are absent.
    tiles = blocks(spark, np.where(np.arange(13) < 4, 0, ARRAY), 3, 4, skip={(b, 0) for b in range(4)})
    want_tiles = [(k, i, j, 0.0 if v is not None and j < 4 else v) for k, i, j, v in want]
    for grid, rows in ((cells, want), (to_blocks(cells, 4, 5), want), (tiles, want_tiles)):
        found = lookup(grid, asked)
        assert found.columns == ["id", "i", "j", "v"]
        assert sorted(map(tuple, found.collect())) == rows


def test_names_that_clash(spark):
    names = "v string, vals int, nr int, bi int, `a.b` int, present int, asked int, i int, j int"
    asked = spark.createDataFrame([("x", 1, 2, 3, 4, 5, 6, 7, 8)], names)
    for grid in (sparse_cells(spark, ARRAY), blocks(spark, ARRAY, 3, 4)):
        found = lookup(grid, asked)
        assert [*found.first()] == [1, 2, 3, 4, 5, 6, 7, 8, ARRAY[7, 8]]


def test_batches(spark):
    cells = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 6.0)], "year int, i bigint, j bigint, v double")
    grid = CellGrid(cells, 2, 2, keys=("year",))
    asked = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0), (None, 0, 0), (2, 1, 1)], "year int, i bigint, j bigint")
    want = {(1, 0): 5.0, (2, 0): 6.0, (3, 0): 0.0, (None, 0): None, (2, 1): 0.0}
    for g in (grid, to_blocks(grid, 1, 2)):
        assert {(r["year"], r["i"]): r["v"] for r in lookup(g, asked).collect()} == want
    with pytest.raises(ValueError, match="year"):
        lookup(grid, asked.drop("year"))


def test_null_cells_stay_null(spark):
    grid = CellGrid(spark.createDataFrame([(0, 0, None)], "i bigint, j bigint, v double"), 1, 2)
    asked = spark.createDataFrame([(0, 0), (0, 1)], "i bigint, j bigint")
    assert sorted(r["v"] is None for r in lookup(grid, asked).collect()) == [False, True]


def test_outside_fails(spark):
    for at in ((-1, 0), (11, 0), (0, 13)):
        asked = spark.createDataFrame([at], "i bigint, j bigint")
        for grid in (sparse_cells(spark, ARRAY), blocks(spark, ARRAY, 3, 4)):
            with pytest.raises(PySparkException, match="outside the grid"):
                lookup(grid, asked).collect()


def test_nothing_asked_or_there(spark):
    none = spark.createDataFrame([], "i bigint, j bigint")
    empty = CellGrid(none.withColumn("v", F.lit(0.0)), 3, 3)
    one = spark.createDataFrame([(1, 1)], "i bigint, j bigint")
    for grid in (empty, to_blocks(empty, 2, 2)):
        assert lookup(grid, none).count() == 0
        assert lookup(grid, one).collect()[0]["v"] == 0.0


def test_few_tiles_limit_the_scan_of_a_stored_grid(spark):
    size = 40 * 25
    cells = spark.range(size * size).select(F.expr("id div 1000 AS i"), (F.col("id") % 1000).alias("j"), F.col("id").cast("double").alias("v"))
    tiles = to_blocks(CellGrid(cells, size, size, unique=True, dense=True), 25, 25)
    name = f"grid_{uuid4().hex}"
    grid = save_grid(tiles, name, 4, scratch_path(spark, name))
    asked = spark.range(500).select((F.col("id") % 40 + 100).alias("i"), (F.col("id") % 37 + 300).alias("j"))
    found = lookup(grid, asked)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    scan = found._jdf.queryExecution().toString().split("PushedFilters")
    assert "GreaterThanOrEqual(bi,4)" in scan[-1] and "GreaterThanOrEqual(bj,12)" in scan[-1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(r["v"] == r["i"] * 1000 + r["j"] for r in found.collect())
    # 10^5 positions in more tiles than are named.
    many = spark.range(100_000).select((F.col("id") * 7919 % size).alias("i"), (F.col("id") * 104_729 % 997).alias("j"))
    assert size * size // 625 > MAX_NAMED
    found = lookup(grid, many)
    assert found.count() == 100_000 and found.where("v <> i * 1000 + j").count() == 0
