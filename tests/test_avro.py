"""Sidecars in Avro, written here byte by byte."""

import json
import zlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridlake.operators.blocks import cells_from_rows
from gridlake.operators.elementwise import map_values
from gridlake.sources.avro import first_record
from gridlake.sources.dataset import load_dataset
from gridlake.sources.metadata import Metadata, Variable

TEXT = ["null", "string"]
SCHEMA = {
    "type": "record",
    "name": "Metadata",
    "namespace": "some.where",
    "fields": [
        {"name": "id", "type": "long"},
        {
            "name": "variables",
            "type": {
                "type": "array",
                "items": {
                    "type": "record",
                    "name": "Variable",
                    "fields": [
                        {"name": "name", "type": "string"},
                        {"name": "units", "type": TEXT},
                        {"name": "dims", "type": {"type": "array", "items": "string"}},
                        {"name": "attributes", "type": {"type": "map", "values": TEXT}},
                    ],
                },
            },
        },
        {"name": "other", "type": ["null", "some.where.Variable"]},
    ],
}
SYNC = bytes(range(16))
META = Metadata(
    (
        Variable("time", "days since 1995-01-01", ("time",), {"calendar": "360_day", "länge": "é"}),
        Variable("tas", None, ("time", "x" * 100), {}),
    )
)


def number(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def text(s: str | bytes) -> bytes:
    raw = s if isinstance(s, bytes) else s.encode()
    return number(len(raw)) + raw


def maybe(s: str | None) -> bytes:
    return number(0) if s is None else number(1) + text(s)


def variable(v: Variable) -> bytes:
    dims = b"".join(map(text, v.dims))
    attributes = b"".join(text(k) + maybe(a) for k, a in v.attributes.items())
    out = text(v.name) + maybe(v.units)
    out += number(len(v.dims)) + dims + number(0)
    # A negative number of items, followed by the size of the block.
    return out + (number(-len(v.attributes)) + text(attributes) if v.attributes else b"") + number(0)


def record(meta: Metadata, id: int = -5_000_000_000) -> bytes:
    # One block for each variable.
    blocks = b"".join(number(1) + variable(v) for v in meta.variables) + number(0)
    return number(id) + blocks + number(1) + variable(meta.variables[0])


def container(*records: bytes, codec: str | None = None, schema=SCHEMA) -> bytes:
    header = {"avro.schema": json.dumps(schema)} | ({"avro.codec": codec} if codec else {})
    out = b"Obj\x01" + number(len(header)) + b"".join(text(k) + text(v) for k, v in header.items()) + number(0) + SYNC
    for one in records:
        if codec == "deflate":
            packer = zlib.compressobj(wbits=-15)
            one = packer.compress(one) + packer.flush()
        out += number(1) + text(one) + SYNC
    return out


@pytest.mark.parametrize("codec", [None, "null", "deflate"])
def test_sidecar(spark, tmp_path, codec):
    path = tmp_path / "data"
    spark.range(3).write.parquet(str(path))
    second = Metadata((Variable("second"),))
    (tmp_path / "data.meta").write_bytes(container(record(META), record(second), codec=codec))
    meta, df = load_dataset(spark, str(path), "avro")
    assert meta == META and df.count() == 3


def test_folders_empty_and_missing_sidecars(spark, tmp_path):
    path = tmp_path / "data"
    spark.range(3).write.parquet(str(path))
    with pytest.raises(AnalysisException):
        load_dataset(spark, str(path), "avro")
    folder = tmp_path / "data.meta"
    folder.mkdir()
    (folder / "part-0.avro").write_bytes(container())
    assert load_dataset(spark, str(path), "avro")[0] is None
    (folder / "part-1.avro").write_bytes(container(record(META)))
    assert load_dataset(spark, str(path), "avro")[0] == META
    (folder / "part-0.avro").write_bytes(container(number(1), schema={"type": "record", "name": "R", "fields": [{"name": "n", "type": "int"}]}))
    with pytest.raises(ValueError, match="no list of variables"):
        load_dataset(spark, str(path), "avro")


def test_damaged_files():
    good = container(record(META))
    assert first_record(good)["id"] == -5_000_000_000 and first_record(good)["other"]["name"] == "time"
    nameless = container(record(META)).replace(b"\x02\x16avro.schema", b"\x02\x16avro.schemb")
    for damaged in (b"", nameless, container(b"\xff\xff", codec="deflate")[:-18] + b"\xff\xff" + SYNC, b"PAR1", good[:-1], good[:40], good[:-16] + bytes(16), container(record(META), codec="snappy")):
        with pytest.raises(ValueError):
            first_record(damaged)


def test_other_types():
    fields = [
        ("yes", "boolean", b"\1", True),
        ("f", "float", b"\0\0\xc0\x3f", 1.5),
        ("d", "double", b"\0\0\0\0\0\0\xf8\xbf", -1.5),
        ("b", "bytes", text(b"\xff"), b"\xff"),
        ("e", {"type": "enum", "name": "E", "symbols": ["A", "B"]}, number(1), "B"),
        ("again", "E", number(0), "A"),
        ("x", {"type": "fixed", "name": "X", "size": 2}, b"ab", b"ab"),
        ("when", {"type": "long", "logicalType": "timestamp-micros"}, number(7), 7),
    ]
    schema = {"type": "record", "name": "R", "fields": [{"name": n, "type": t} for n, t, _, _ in fields]}
    raw = b"".join(bytes(r) for _, _, r, _ in fields)
    assert first_record(container(raw, schema=schema)) == {n: v for n, _, _, v in fields}


def test_functions_may_be_pandas_udfs(spark):
    twice = pandas_udf(lambda v: v * 2, "double")
    grid = map_values(cells_from_rows(spark, [[1, 2], [0, 4]]), twice)
    assert sorted(r.v for r in grid.df.select(F.col("v")).collect()) == [0, 2, 4, 8]
