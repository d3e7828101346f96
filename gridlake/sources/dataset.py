"""Parquet datasets with a metadata sidecar next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlake.sources.avro import first_record
from gridlake.sources.metadata import (
    METADATA_SCHEMA,
    Metadata,
    first_metadata,
    metadata_frame,
    metadata_from_record,
)


def load_dataset(
    spark: SparkSession, path: str, sidecar_format: str = "json"
) -> tuple[Metadata | None, DataFrame]:
    """The Parquet data at ``path`` and the first record of its sidecar ``path + ".meta"``.

    An empty sidecar gives no metadata; a missing one is an error. Sidecars are JSON, ``avro``
    containers (a file, or a folder of which the first file with a record counts), or in any other
    ``sidecar_format`` the session can read.
    """
    sidecar = path.rstrip("/") + ".meta"
    if sidecar_format == "avro":
        files = spark.read.format("binaryFile").load(sidecar).select("path", "content").orderBy("path")
        found = (first_record(bytes(row.content)) for row in files.toLocalIterator())
        record = next((r for r in found if r is not None), None)
        return metadata_from_record(record), spark.read.parquet(path)
    if sidecar_format == "json":
        records = metadata_frame(spark, sidecar)
    else:
        records = spark.read.format(sidecar_format).schema(METADATA_SCHEMA).load(sidecar)
    return first_metadata(records), spark.read.parquet(path)


def save_dataset(df: DataFrame, meta: Metadata | None, path: str, mode: str = "error") -> None:
    """Write data and sidecar in the form ``load_dataset`` reads."""
    spark = df.sparkSession
    df.write.mode(mode).parquet(path)
    record = spark.createDataFrame([(meta.to_json(),)] if meta else [], "value STRING")
    record.coalesce(1).write.mode(mode).text(path.rstrip("/") + ".meta")
