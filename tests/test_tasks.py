from gridlake.grid import CellGrid
from gridlake.operators.blocks import TASKS_PER_CORE, densify, tasks_for, to_blocks


def test_tasks_follow_the_cores_not_the_claimed_size(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (999_999, 999_999, 2.0)], "i BIGINT, j BIGINT, v DOUBLE")
    grid = CellGrid(df, 1_000_000, 1_000_000, unique=True)
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    tiles = to_blocks(grid, 16, 64).df
    assert tiles.rdd.getNumPartitions() <= most
    assert sorted((r.bi, r.bj, sum(r.vals)) for r in tiles.collect()) == [(0, 0, 1.0), (62_499, 15_624, 2.0)]


def test_more_shuffle_partitions_give_more_tasks(spark):
    grid = CellGrid(spark.createDataFrame([(0, 0, 1.0)], "i BIGINT, j BIGINT, v DOUBLE"), 1000, 1000, unique=True)
    assert tasks_for(grid, 1 << 20) == 2 and densify(grid).df.count() == 1_000_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "500")
    try:
        assert tasks_for(grid, 1 << 40) == max(500, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
