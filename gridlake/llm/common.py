"""Pieces that several operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

# White space that separates words, as a pattern for words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set, but only for a local master, whose executors
    are threads of this process; elsewhere it raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith(
            "local-cluster"
        ):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a written table: computed once, and safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def widened(df: DataFrame, drop: Iterable[str] = (), **new: str) -> StructType:
    """The schema of ``df`` without ``drop``, and with ``new`` columns of the given types after it."""
    drop = set(drop)
    kept = [f for f in df.schema if f.name not in drop]
    return StructType(kept + [StructField(name, DataType.fromDDL(kind)) for name, kind in new.items()])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, empty where it is null."""
    return F.coalesce(df[name], F.lit(""))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; 0 for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus, F.lit(0))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a batch one after another, and where each one begins.

    There is one more offset than texts, for the end. A null text is empty.
    """
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; a null text is empty."""
    data, at = flat(column)
    raw = data.tobytes()
    at = at.tolist()
    for start, end in zip(at, at[1:]):
        yield raw[start:end]


def pieces(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column("text")
        at = flat(column)[1]
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


_SPACE = re.compile(rb"[ \t-\r]")


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of ``size`` bytes and more, each up to the next white space."""
    start = 0
    while start < len(text):
        space = _SPACE.search(text, start + size)
        end = space.start() if space else len(text)
        yield text[start:end]
        start = end


def with_columns(batch: pa.RecordBatch, drop: Iterable[str], **new: pa.Array) -> pa.RecordBatch:
    """The batch without the columns ``drop`` and with the ``new`` ones after the others."""
    drop = set(drop)
    kept = [n for n in batch.schema.names if n not in drop]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in kept] + list(new.values()), names=kept + list(new)
    )
