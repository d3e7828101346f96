"""Zone maps of array files: which ranges of records can hold a range of a coordinate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlake.sources import netcdf

ZONES = "file STRING, size BIGINT, records BIGINT, first BIGINT, end BIGINT, low DOUBLE, high DOUBLE, nan BOOLEAN, ascending BOOLEAN"


def _values(file, header: netcdf.ArrayHeader, var: netcdf.ArrayVariable, change, lo: int, hi: int) -> np.ndarray:
    values = netcdf.read_values(file, header, var, lo, hi)
    # As the scan gives them: in the units of the first file, missing values as they are stored.
    column = netcdf._column(values, var, False, netcdf._axis(header, var), change)
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _zones_of(path: str, size: int, coordinate: str, axis: netcdf.Axis | None, step: int) -> Iterator[tuple]:
    with netcdf._open(path) as file:
        header = netcdf.read_header(file, size)
        var = header.variables.get(coordinate)
        if var is None or len(var.dims) != 1:
            raise ValueError(f"{path} has no variable {coordinate} of one dimension")
        change = netcdf._conversion(path, coordinate, netcdf._axis(header, var), axis)
        total = var.shape[0]
        for first in range(0, total, step):
            end = min(first + step, total)
            values = _values(file, header, var, change, first, end)
            known = values[~np.isnan(values)]
            low, high = (float(known.min()), float(known.max())) if len(known) else (None, None)
            ascending = len(known) == len(values) and bool((np.diff(values) >= 0).all())
            yield path, size, total, first, end, low, high, len(known) < len(values), ascending


def zone_map(spark: SparkSession, path: str, coordinate: str, step: int = 1 << 16) -> DataFrame:
    """``file, size, records, first, end, low, high, nan, ascending`` for each ``step`` records of each file.

    ``low`` and ``high`` are the least and greatest value of ``coordinate``, a variable of the leading
    dimension, in the units of the first file as ``read_netcdf`` gives them; NULL if all are NaN. ``nan``
    says that some are, ``ascending`` that the values are in order.

    Each task reads headers and this one variable of its files. The rows are few and worth storing: write
    them as Parquet next to the files, and again when files change.
    """
    if step <= 0:
        raise ValueError(f"zones must have records: {step}")
    files = netcdf.list_files(netcdf.qualified(spark, path))
    with netcdf._open(files[0][0]) as file:
        header = netcdf.read_header(file, files[0][1])
    if coordinate not in header.variables:
        raise ValueError(f"no such variable: {coordinate}")
    axis = netcdf._axis(header, header.variables[coordinate])
    names = [field.split()[0] for field in ZONES.split(", ")]

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch["file"].to_pylist(), batch["size"].to_pylist()):
                columns = zip(*_zones_of(name, size, coordinate, axis, step))
                kinds = [pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 2, *[pa.bool_()] * 2]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, names=names)

    listed = spark.createDataFrame(files, "file STRING, size BIGINT")
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    return listed.repartitionByRange(tasks, "file").mapInArrow(scan, ZONES)


def zones_between(zones: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``file, size, records, first, end``: the ranges that may hold ``low <= value <= high``.

    Neighbouring ranges of a file are one. A range with NaN is always among them, as NaN is larger than
    any number to a filter.
    """
    inside = F.lit(True)
    if low is not None:
        inside &= F.col("high") >= low
    if high is not None:
        inside &= F.col("low") <= high
    hit = zones.where(F.col("nan") | F.coalesce(inside, F.lit(False)))
    by_file = Window.partitionBy("file").orderBy("first")
    apart = F.coalesce(F.lag("end").over(by_file) != F.col("first"), F.lit(True))
    numbered = hit.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_file))
    return numbered.groupBy("file", "size", "records", "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).drop("run")


def read_netcdf_between(
    spark: SparkSession,
    path: str,
    zones: DataFrame,
    coordinate: str,
    low: float,
    high: float,
    variables: Sequence[str] = (),
    **options,
) -> DataFrame:
    """The rows of ``read_netcdf`` with ``low <= coordinate < high``, from the ranges that can hold them.

    ``zones`` is the zone map of these files. Files and ranges outside are not opened, but for the header
    of the first file. The driver gets one row for each range of records that is read.
    """
    ranges = zones_between(zones, low, high).orderBy("file", "first").collect()
    df = netcdf.read_netcdf(spark, path, variables, coordinates=True, ranges=[tuple(r) for r in ranges], **options)
    value = F.col(f"`{coordinate}`")
    return df.where((value >= low) & (value < high))
