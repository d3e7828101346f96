"""The first record of an Avro container file, for sidecars of one small record.

Tables in Avro are for Spark's own reader; this needs no package, and reads one record on the driver.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from typing import Any

MAGIC = b"Obj\x01"
SYNC = 16


class _Reader:
    """Values of Avro's binary encoding, one after another."""

    def __init__(self, data: bytes):
        self.data = data
        self.at = 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the Avro data ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def long(self) -> int:
        """Seven bits in a byte, lowest first, and the sign in the lowest bit."""
        value = shift = 0
        while True:
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return (value >> 1) ^ -(value & 1)
            shift += 7
            if shift > 63:
                raise ValueError("an Avro number is too long")

    def bytes(self) -> bytes:
        return self.take(self.long())

    def counts(self) -> Iterator[int]:
        """Items of an array or a map, which come in blocks; a negative number is followed by a size."""
        while n := self.long():
            if n < 0:
                n = -n
                self.long()
            yield from range(n)


def _named(schema: Any, names: dict[str, Any], space: str = "") -> None:
    """Collect the types that a schema defines, by full and by short name."""
    if isinstance(schema, list):
        for branch in schema:
            _named(branch, names, space)
    elif isinstance(schema, dict):
        if schema.get("type") in ("record", "error", "enum", "fixed"):
            space = schema.get("namespace", space)
            short = schema["name"].rsplit(".", 1)[-1]
            full = schema["name"] if "." in schema["name"] else f"{space}.{short}".strip(".")
            names[full] = schema
            names.setdefault(short, schema)
        for field in schema.get("fields", ()):
            _named(field["type"], names, space)
        for inner in ("items", "values"):
            _named(schema.get(inner), names, space)
        if isinstance(schema.get("type"), (dict, list)):
            _named(schema["type"], names, space)


def _value(reader: _Reader, schema: Any, names: dict[str, Any]) -> Any:
    if isinstance(schema, list):
        branch = reader.long()
        if not 0 <= branch < len(schema):
            raise ValueError(f"the Avro union has no branch {branch}")
        return _value(reader, schema[branch], names)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if not isinstance(kind, str):
        return _value(reader, kind, names)
    match kind:
        case "null":
            return None
        case "boolean":
            return reader.take(1) != b"\0"
        case "int" | "long":
            return reader.long()
        case "float":
            return struct.unpack("<f", reader.take(4))[0]
        case "double":
            return struct.unpack("<d", reader.take(8))[0]
        case "bytes":
            return reader.bytes()
        case "string":
            return reader.bytes().decode()
        case "array":
            return [_value(reader, schema["items"], names) for _ in reader.counts()]
        case "map":
            return {reader.bytes().decode(): _value(reader, schema["values"], names) for _ in reader.counts()}
        case "record" | "error":
            return {field["name"]: _value(reader, field["type"], names) for field in schema["fields"]}
        case "enum":
            symbol = reader.long()
            if not 0 <= symbol < len(schema["symbols"]):
                raise ValueError(f"the Avro enum has no symbol {symbol}")
            return schema["symbols"][symbol]
        case "fixed":
            return reader.take(schema["size"])
    if kind not in names:
        raise ValueError(f"unknown Avro type: {kind}")
    return _value(reader, names[kind], names)


def first_record(data: bytes) -> dict[str, Any] | None:
    """The first record of a container, or ``None`` if it has none.

    Blocks may be plain or deflated. Damaged data, another codec and an empty file raise ``ValueError``.
    """
    reader = _Reader(data)
    if reader.take(4) != MAGIC:
        raise ValueError("not an Avro container")
    header = {reader.bytes().decode(): reader.bytes() for _ in reader.counts()}
    sync = reader.take(SYNC)
    if "avro.schema" not in header:
        raise ValueError("the Avro container has no schema")
    schema = json.loads(header["avro.schema"])
    codec = header.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise ValueError(f"this Avro codec is not read: {codec}")
    names: dict[str, Any] = {}
    _named(schema, names)
    while reader.at < len(data):
        records, block = reader.long(), reader.bytes()
        if reader.take(SYNC) != sync:
            raise ValueError("the Avro block does not end where it should")
        if records:
            try:
                plain = zlib.decompress(block, -15) if codec == "deflate" else block
            except zlib.error as e:
                raise ValueError("an Avro block cannot be inflated") from e
            return _value(_Reader(plain), schema, names)
    return None
