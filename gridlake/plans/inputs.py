"""Grids and time axes derived from the test tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.grid import CellGrid
from gridlake.operators.shape import sum_duplicates, with_dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quantities(spark: SparkSession, sf_dir: str, flag: str | None = None) -> CellGrid:
    """Quantity by supplier and part, of return flag A, of the ``rest`` or of all; one cell per line item."""
    items = table(spark, sf_dir, "lineitem")
    whole = with_dims(CellGrid(items.select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))))
    if flag is not None:
        items = items.where((F.col("l_returnflag") == "A") == F.lit(flag == "A"))
    cells = items.select(
        F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("v")
    )
    return whole.with_df(cells)


def sales(spark: SparkSession, sf_dir: str, flag: str | None = None) -> CellGrid:
    """Total quantity by supplier and part: large and sparse."""
    return sum_duplicates(quantities(spark, sf_dir, flag))


def part_lines(spark: SparkSession, sf_dir: str) -> CellGrid:
    """Total quantity by part and line number."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("i"),
        (F.col("l_linenumber").cast("bigint") - 1).alias("j"),
        F.col("l_quantity").alias("v"),
    )
    return sum_duplicates(with_dims(CellGrid(cells)))


def supplier_lines(spark: SparkSession, sf_dir: str, yearly: bool = False) -> CellGrid:
    """Total quantity by supplier and line number, and by year of shipping if asked for."""
    keys = ("year",) if yearly else ()
    cells = table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.col("l_suppkey").alias("i"),
        (F.col("l_linenumber").cast("bigint") - 1).alias("j"),
        F.col("l_quantity").alias("v"),
    )
    grid = with_dims(CellGrid(cells.select(*keys, "i", "j", "v"), keys=keys))
    return sum_duplicates(grid)


def vectors(spark: SparkSession, sf_dir: str) -> CellGrid:
    """The embedding table as a dense grid: one row per vector."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")
    )
    cells = cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"))
    return with_dims(CellGrid(cells, unique=True, dense=True))


def shipping_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a time coordinate ``t``: days from 1995-01-01 to shipping."""
    return table(spark, sf_dir, "lineitem").select(
        F.datediff(F.col("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("double").alias("t"),
        "l_quantity",
        "l_returnflag",
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder that the session names for checkpoints.

    Without one it raises, but for a local master, whose executors are threads of this process.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid4().hex}"
