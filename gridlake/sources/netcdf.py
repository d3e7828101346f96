"""Array files in the public NetCDF classic formats, as a Spark data source.

``read_netcdf`` turns files into long-form rows: the file, one index column per dimension and
one column per variable. Planning lists the files and cuts them by size; it opens one of them
for the schema. Each task then opens its own file, reads the header and seeks to its range, so
neither large files nor many files pass through one process. The first file's units also hold for
the time coordinates of the others, which are converted to them.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, prod
from typing import BinaryIO
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridlake.functions.calendar import DAY_MS, TimeUnit
from gridlake.sources.metadata import Metadata, Variable

# Fixed values of the format: type codes and list tags.
NUMPY_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8"}
SPARK_TYPES = {
    1: T.ByteType(),
    2: T.StringType(),
    3: T.ShortType(),
    4: T.IntegerType(),
    5: T.FloatType(),
    6: T.DoubleType(),
    7: T.ShortType(),
    8: T.IntegerType(),
    9: T.LongType(),
    10: T.LongType(),
}
DIMENSIONS, VARIABLES, ATTRIBUTES = 0x0A, 0x0B, 0x0C
STREAMING = 0xFFFFFFFF
SINCE = re.compile(r"\s*\w+\s+since\s", re.IGNORECASE)

BATCH_CELLS = 1 << 16
BATCH_BYTES = 64 << 20
SPLIT_BYTES = 128 << 20
SKIP_BYTES = 4096  # between the parts of two records: a seek is cheaper than reading more


@dataclass(frozen=True)
class ArrayVariable:
    name: str
    type_code: int
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    begin: int
    is_record: bool
    attributes: dict[str, str | np.ndarray] = field(default_factory=dict)

    @property
    def item_bytes(self) -> int:
        return np.dtype(NUMPY_TYPES[self.type_code]).itemsize

    @property
    def per_record(self) -> int:
        """Elements in one record, or all of them for a variable of fixed size."""
        return prod(self.shape[1:]) if self.is_record else prod(self.shape)


@dataclass(frozen=True)
class ArrayHeader:
    variables: dict[str, ArrayVariable]
    record_bytes: int


class _HeaderReader:
    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        if file.read(3) != b"CDF":
            raise ValueError("not a NetCDF classic file")
        self.version = file.read(1)[0]
        if self.version not in (1, 2, 5):
            raise ValueError(f"unsupported NetCDF classic version {self.version}")
        self.size_format = ">Q" if self.version == 5 else ">I"

    def unpack(self, form: str) -> int:
        return struct.unpack(form, _read_exactly(self.file, struct.calcsize(form)))[0]

    def size(self) -> int:
        return self.unpack(self.size_format)

    def padded(self, length: int) -> bytes:
        return _read_exactly(self.file, length + -length % 4)[:length]

    def name(self) -> str:
        return self.padded(self.size()).decode()

    def list_of(self, tag: int) -> range:
        found, count = self.unpack(">I"), self.size()
        if found not in (0, tag) or (found == 0 and count):
            raise ValueError("damaged NetCDF header")
        return range(count)

    def attributes(self) -> dict[str, str | np.ndarray]:
        found = {}
        for _ in self.list_of(ATTRIBUTES):
            name, code = self.name(), self.unpack(">I")
            kind = np.dtype(NUMPY_TYPES[code])
            data = self.padded(self.size() * kind.itemsize)
            text = data.rstrip(bytes(1)).decode("utf-8", "replace")
            found[name] = text if code == 2 else np.frombuffer(data, kind)
        return found


def read_header(file: BinaryIO, file_bytes: int) -> ArrayHeader:
    """Variables of a file and where their values are."""
    reader = _HeaderReader(file)
    records = reader.size()
    dims = [(reader.name(), reader.size()) for _ in reader.list_of(DIMENSIONS)]
    reader.attributes()
    found = []
    for _ in reader.list_of(VARIABLES):
        name = reader.name()
        ids = [reader.size() for _ in range(reader.size())]
        attributes = reader.attributes()
        type_code = reader.unpack(">I")
        reader.size()  # a redundant length, which may overflow
        begin = reader.unpack(">I" if reader.version == 1 else ">Q")
        found.append((name, type_code, ids, begin, attributes))

    def is_record(ids: list[int]) -> bool:
        return bool(ids) and dims[ids[0]][1] == 0

    def record_part(type_code: int, ids: list[int]) -> int:
        item = np.dtype(NUMPY_TYPES[type_code]).itemsize
        return item * prod(dims[d][1] for d in ids[1:])

    parts = [record_part(t, ids) for _, t, ids, *_ in found if is_record(ids)]
    # Records are padded to four bytes per variable, except when there is only one variable.
    record_bytes = parts[0] if len(parts) == 1 else sum(p + -p % 4 for p in parts)
    if records == STREAMING and reader.version != 5 and parts:
        first = min(begin for _, _, ids, begin, _ in found if is_record(ids))
        records = (file_bytes - first) // record_bytes
    variables = {}
    for name, type_code, ids, begin, attributes in found:
        shape = tuple(dims[d][1] for d in ids)
        if is_record(ids):
            shape = (records, *shape[1:])
        names = tuple(dims[d][0] for d in ids)
        variables[name] = ArrayVariable(name, type_code, names, shape, begin, is_record(ids), attributes)
    return ArrayHeader(variables, record_bytes)


def _read_exactly(file: BinaryIO, count: int) -> bytes:
    data = file.read(count)
    if len(data) != count:
        raise ValueError(f"the file ends {count - len(data)} bytes too early")
    return data


def read_values(file: BinaryIO, header: ArrayHeader, var: ArrayVariable, lo: int, hi: int) -> np.ndarray:
    """Elements ``lo`` to ``hi`` of a variable in index order."""
    item, per = var.item_bytes, var.per_record
    kind = np.dtype(NUMPY_TYPES[var.type_code])
    first, last = (lo // per, (hi - 1) // per) if var.is_record else (0, 0)
    if first == last:
        file.seek(var.begin + first * header.record_bytes + (lo - first * per) * item)
        return np.frombuffer(_read_exactly(file, (hi - lo) * item), kind)
    if header.record_bytes - per * item >= SKIP_BYTES:
        parts = []
        for record in range(first, last + 1):
            start, end = max(lo, record * per), min(hi, (record + 1) * per)
            file.seek(var.begin + record * header.record_bytes + (start - record * per) * item)
            parts.append(_read_exactly(file, (end - start) * item))
        return np.frombuffer(b"".join(parts), kind)
    file.seek(var.begin + first * header.record_bytes)
    data = _read_exactly(file, (last - first) * header.record_bytes + per * item)
    rows = np.ndarray(
        (last - first + 1, per), kind, buffer=data, strides=(header.record_bytes, item)
    )
    return rows.reshape(-1)[lo - first * per : hi - first * per]


def batches(header: ArrayHeader, chosen: Sequence[ArrayVariable], lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Cut a range of elements so that each read stays within the batch limits."""
    step, per = BATCH_CELLS, 0
    if chosen[0].is_record:
        per = chosen[0].per_record
        if per <= BATCH_CELLS:
            records = max(1, min(BATCH_CELLS // max(per, 1), BATCH_BYTES // max(header.record_bytes, 1)))
            step = records * per
    while lo < hi:
        end = min(lo + step, hi)
        if per > BATCH_CELLS or (per and step == per):
            end = min(end, (lo // per + 1) * per)  # stay inside one record
        yield lo, end
        lo = end


def _locate(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme: without one it lies in the default filesystem of Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def list_files(path: str) -> list[tuple[str, int]]:
    """Path and size of a file, or of every ``.nc`` file below a directory."""
    filesystem, inner = _locate(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(".nc")]
    if not files:
        raise FileNotFoundError(f"no .nc files in {path}")
    return sorted((prefix + f.path, f.size) for f in files)


def _open(path: str):
    filesystem, inner = _locate(path)
    return filesystem.open_input_file(inner)


def _choose(header: ArrayHeader, names: Sequence[str]) -> list[ArrayVariable]:
    """The variables to read, which must share their dimensions."""
    if not names:
        names = [n for n, v in header.variables.items() if v.dims and v.dims != (n,)]
    missing = [n for n in names if n not in header.variables]
    if missing:
        raise ValueError(f"no such variable: {', '.join(missing)}")
    chosen = [header.variables[n] for n in names]
    if len({v.dims for v in chosen}) != 1:
        raise ValueError(f"choose variables with the same dimensions, not {', '.join(names)}")
    return chosen


def _coordinates(header: ArrayHeader, chosen: Sequence[ArrayVariable]) -> list[ArrayVariable]:
    """The coordinate variables of the dimensions, such as ``lat`` along ``lat``, that are not chosen."""
    taken = {v.name for v in chosen}
    known = (header.variables.get(d) for d in chosen[0].dims if d not in taken)
    return [v for v in known if v is not None and v.dims == (v.name,)]


def _index_names(chosen: Sequence[ArrayVariable], others: Sequence[ArrayVariable] = ()) -> list[str]:
    """Names of the index columns: the dimensions, told apart from variables named like them."""
    taken = {v.name for v in [*chosen, *others]}
    return [f"{d}_index" if d in taken else d for d in chosen[0].dims]


Axis = tuple[str, str | None]  # units and calendar of a time coordinate


def _axis(header: ArrayHeader, var: ArrayVariable) -> Axis | None:
    """What a time coordinate counts, or ``None`` for other variables. Bounds count what their coordinate does."""
    if "units" not in var.attributes:
        named = (v for v in header.variables.values() if var.name in (v.attributes.get("bounds"), v.attributes.get("climatology")))
        var = next(named, var)
    units, calendar = (var.attributes.get(n) for n in ("units", "calendar"))
    if not isinstance(units, str) or not SINCE.match(units):
        return None
    return units, calendar if isinstance(calendar, str) else None


def _conversion(path: str, name: str, own: Axis | None, first: Axis | None) -> tuple[TimeUnit, TimeUnit] | None:
    """From which unit to which the times of a file are converted; ``None`` if they stay.

    Raises where that is not possible: another calendar, none, or a unit that has no fixed length.
    """
    if own == first:
        return None
    try:
        if None in (own, first) or None in (*own, *first):
            raise ValueError("it takes units and a calendar in both files")
        units = [TimeUnit.parse(calendar, text) for text, calendar in (own, first)]
        if units[0].calendar != units[1].calendar:
            raise ValueError("the calendars differ")
    except ValueError as error:
        raise ValueError(f"{path}: cannot convert {name} from {own} to {first} of the first file: {error}") from error
    return None if units[0] == units[1] else (units[0], units[1])


def _converted(values: np.ndarray, own: TimeUnit, first: TimeUnit) -> np.ndarray:
    shift = (own.base_day - first.base_day) * DAY_MS + own.base_ms - first.base_ms
    return (values * own.unit_ms + shift) / first.unit_ms


class NetcdfSource(DataSource):
    """``spark.read.format("netcdf3")``; options ``variables``, ``leading``, ``splitBytes``, ``decode`` and
    ``coordinates``."""

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def _variables(self) -> list[str]:
        return [n.strip() for n in self.options.get("variables", "").split(",") if n.strip()]

    def _is(self, option: str) -> bool:
        return self.options.get(option, "false").lower() == "true"

    def _first_header(self) -> ArrayHeader:
        path, size = list_files(self.options["path"])[0]
        with _open(path) as file:
            return read_header(file, size)

    def schema(self) -> T.StructType:
        header = self._first_header()
        chosen = _choose(header, self._variables())
        others = _coordinates(header, chosen) if self._is("coordinates") else []
        fields = [T.StructField("file", T.StringType())]
        fields += [T.StructField(d, T.LongType(), True, {"dimension": True}) for d in _index_names(chosen, others)]
        fields += [T.StructField(v.name, _spark_type(v, self._is("decode"), _axis(header, v))) for v in [*others, *chosen]]
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        leading, header = self.options.get("leading"), self._first_header()
        return NetcdfReader(
            self.options["path"],
            self._variables(),
            int(self.options.get("splitBytes", SPLIT_BYTES)),
            tuple(map(int, leading.split(":"))) if leading else None,
            schema,
            self._is("decode"),
            self._is("coordinates"),
            {v.name: _axis(header, v) for v in header.variables.values()},
            json.loads(self.options["ranges"]) if "ranges" in self.options else None,
        )


class NetcdfReader(DataSourceReader):
    def __init__(
        self,
        path: str,
        variables: list[str],
        split_bytes: int,
        leading: tuple[int, int] | None,
        schema: T.StructType,
        decode: bool,
        coordinates: bool,
        axes: dict[str, Axis | None],
        ranges: list[tuple[str, int, int, int, int]] | None = None,
    ) -> None:
        self.path, self.variables, self.split_bytes = path, variables, split_bytes
        self.leading, self.schema = leading, schema
        self.decode, self.coordinates, self.axes = decode, coordinates, axes
        self.ranges = ranges

    def partitions(self) -> list[InputPartition]:
        splits = []
        if self.ranges is not None:
            for path, size, records, first, end in self.ranges:
                parts = max(1, ceil(size * (end - first) / max(records, 1) / self.split_bytes))
                splits += [InputPartition((path, size, part, parts, (first, end))) for part in range(parts)]
            return splits or [InputPartition((*list_files(self.path)[0], 0, 1, (0, 0)))]
        for path, size in list_files(self.path):
            parts = max(1, ceil(size / self.split_bytes))
            splits += [InputPartition((path, size, part, parts)) for part in range(parts)]
        return splits

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, size, part, parts, *own = partition.value
        with _open(path) as file:
            header = read_header(file, size)
            chosen = _choose(header, self.variables)
            shape = chosen[0].shape or (1,)
            others = _coordinates(header, chosen) if self.coordinates else []
            names = ["file", *_index_names(chosen, others), *(v.name for v in [*others, *chosen])]
            if names != self.schema.fieldNames():
                raise ValueError(f"{path} has columns {names}, not {self.schema.fieldNames()}")
            axes = {v.name: _axis(header, v) for v in [*others, *chosen]}
            changes = {n: _conversion(path, n, axis, self.axes.get(n)) for n, axis in axes.items()}

            def column(values: np.ndarray, var: ArrayVariable) -> pa.Array:
                return _column(values, var, self.decode, axes[var.name], changes[var.name])

            first, end = self.leading or (0, shape[0])
            below = prod(shape[1:])
            first, end = max(first, 0), min(end, shape[0])
            for low, high in own:
                first, end = max(first, low), min(end, high)
            first, end = first * below, end * below
            wanted = max(end - first, 0)
            lo, hi = (first + wanted * n // parts for n in (part, part + 1))
            for start, stop in batches(header, chosen, lo, hi):
                index = np.unravel_index(np.arange(start, stop), shape) if chosen[0].dims else ()
                columns = [pa.repeat(pa.scalar(path), stop - start)]
                columns += [pa.array(i, pa.int64()) for i in index]
                for var in others:
                    at = index[chosen[0].dims.index(var.name)]
                    low, high = int(at.min()), int(at.max()) + 1
                    columns.append(column(read_values(file, header, var, low, high)[at - low], var))
                for var in chosen:
                    columns.append(column(read_values(file, header, var, start, stop), var))
                yield pa.RecordBatch.from_arrays(columns, names=names)


def _number(var: ArrayVariable, name: str) -> float | None:
    value = var.attributes.get(name)
    return None if value is None or isinstance(value, str) or not len(value) else float(value[0])


def _is_packed(var: ArrayVariable) -> bool:
    return _number(var, "scale_factor") is not None or _number(var, "add_offset") is not None


def _spark_type(var: ArrayVariable, decode: bool, axis: Axis | None) -> T.DataType:
    return T.DoubleType() if axis or (decode and _is_packed(var)) else SPARK_TYPES[var.type_code]


def _column(
    values: np.ndarray, var: ArrayVariable, decode: bool, axis: Axis | None, change: tuple[TimeUnit, TimeUnit] | None
) -> pa.Array:
    if var.type_code == 2:
        return pa.array(np.char.decode(values, "latin-1").tolist(), pa.string())
    missing = None
    if decode or change:
        fills = [var.attributes[n] for n in ("_FillValue", "missing_value") if not isinstance(var.attributes.get(n, ""), str)]
        if fills:
            missing = np.isin(values, np.concatenate(fills).astype(values.dtype.newbyteorder("=")))
    if decode and _is_packed(var):
        scale, shift = _number(var, "scale_factor"), _number(var, "add_offset")
        values = values.astype(np.float64) * (1.0 if scale is None else scale) + (shift or 0.0)
    elif change and _is_packed(var):
        raise ValueError(f"packed times of {var.name} in other units than the first file's need decode=True")
    if change:
        times = values.astype(np.float64)
        values = _converted(times, *change)
        if missing is not None:
            values = np.where(missing, times, values)
    widened = {7: np.int16, 8: np.int32, 9: np.int64}
    as_double = axis or (decode and _is_packed(var))
    native = np.float64 if as_double else widened.get(var.type_code, values.dtype.newbyteorder("="))
    return pa.array(values.astype(native), mask=missing if decode else None)


def netcdf_metadata(spark: SparkSession, path: str) -> Metadata:
    """Units, dimensions and attributes of the variables of array files, from the first file's header.

    They hold for all rows of ``read_netcdf``, which converts the times of the other files to them.
    """
    path, size = list_files(qualified(spark, path))[0]
    with _open(path) as file:
        header = read_header(file, size)

    def text(value: str | np.ndarray) -> str:
        return value if isinstance(value, str) else ", ".join(str(x) for x in value.tolist())

    return Metadata(
        tuple(
            Variable(v.name, v.attributes.get("units"), v.dims, {k: text(x) for k, x in v.attributes.items()})
            for v in header.variables.values()
        )
    )


def read_netcdf(
    spark: SparkSession,
    path: str,
    variables: Sequence[str] = (),
    leading: tuple[int, int] | None = None,
    split_bytes: int = SPLIT_BYTES,
    decode: bool = False,
    coordinates: bool = False,
    ranges: Sequence[tuple[str, int, int, int, int]] | None = None,
) -> DataFrame:
    """Rows ``file``, one index per dimension, one column per variable.

    An index column has the name of its dimension, with ``_index`` added for a coordinate
    variable, such as ``lat`` along ``lat``, that is itself read.

    With ``coordinates`` the values of coordinate variables are columns too. With ``decode`` values equal to
    the attributes ``_FillValue`` or ``missing_value`` are NULL, and packed values are unpacked by
    ``scale_factor`` and ``add_offset`` to doubles.

    A time coordinate, one whose units are such as ``days since 1850-01-01``, is a DOUBLE in the units and the
    calendar of the first file: files may have base moments and units of their own. Another calendar, or other
    units without a calendar to convert them by, raise.

    ``path`` is a file or a directory of ``.nc`` files with the same variables; without a scheme it lies in
    Spark's default filesystem. Variables left out are not read, but for short gaps between records. ``leading`` limits the reading to a half-open range of the first
    dimension, such as some time steps. It is an argument, not a pushed filter, because Spark
    4.1 keeps filters that were pushed into a Python source for later queries on the same
    DataFrame. ``ranges``, such as a zone map gives, limits it to some files and to half-open ranges in
    them: ``(file, size, records of the file, first, end)``.
    """
    spark.dataSource.register(NetcdfSource)
    reader = (
        spark.read.format("netcdf3")
        .option("variables", ",".join(variables))
        .option("splitBytes", split_bytes)
        .option("decode", decode)
        .option("coordinates", coordinates)
    )
    if leading is not None:
        reader = reader.option("leading", "{}:{}".format(*leading))
    if ranges is not None:
        reader = reader.option("ranges", json.dumps([list(r) for r in ranges]))
    return reader.load(qualified(spark, path))


def select_variable(df: DataFrame, name: str) -> DataFrame:
    """One variable of ``read_netcdf``: its indices and its value as ``v``."""
    if name not in df.columns:
        raise ValueError(f"no such variable: {name}")
    dims = [f.name for f in df.schema if f.metadata.get("dimension")]
    return df.select("file", *dims, F.col(name).alias("v"))


# --- writing -----------------------------------------------------------------------------------


def _padded_name(name: str) -> bytes:
    raw = name.encode()
    return struct.pack(">I", len(raw)) + raw + bytes(-len(raw) % 4)


Attributes = Mapping[str, Mapping[str, str | float]]


def _encoded_attributes(attributes: Mapping[str, str | float]) -> bytes:
    out = struct.pack(">II", ATTRIBUTES if attributes else 0, len(attributes))
    for name, value in attributes.items():
        raw = value.encode() if isinstance(value, str) else struct.pack(">d", value)
        code, count = (2, len(raw)) if isinstance(value, str) else (6, 1)
        out += _padded_name(name) + struct.pack(">II", code, count) + raw + bytes(-len(raw) % 4)
    return out


def encode_file(dim: str, columns: dict[str, np.ndarray], attributes: Attributes | None = None) -> bytes:
    """A 64-bit-offset classic file with one-dimensional variables of equal length."""
    codes = {np.dtype(t).newbyteorder("=").str[1:]: c for c, t in NUMPY_TYPES.items() if c in (1, 3, 4, 5, 6)}
    length = len(next(iter(columns.values())))
    described = []
    for name, values in columns.items():
        code = codes.get(values.dtype.str[1:])
        if code is None:
            raise ValueError(f"no classic type for column {name} of {values.dtype}")
        data = values.astype(NUMPY_TYPES[code]).tobytes()
        described.append((name, code, data + bytes(-len(data) % 4)))

    def header(begins: Sequence[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", 0)
        out += struct.pack(">II", DIMENSIONS, 1) + _padded_name(dim) + struct.pack(">I", length)
        out += struct.pack(">II", 0, 0) + struct.pack(">II", VARIABLES, len(described))
        for (name, code, data), begin in zip(described, begins):
            out += _padded_name(name) + struct.pack(">II", 1, 0) + _encoded_attributes((attributes or {}).get(name, {}))
            out += struct.pack(">IIQ", code, min(len(data), STREAMING), begin)
        return out

    at, begins = len(header([0] * len(described))), []
    for _, _, data in described:
        begins.append(at)
        at += len(data)
    return header(begins) + b"".join(data for _, _, data in described)


def write_netcdf(
    df: DataFrame,
    path: str,
    dim: str = "row",
    max_rows: int = 1 << 22,
    mode: str = "error",
    attributes: Attributes | None = None,
) -> int:
    """Write numeric columns as one-dimensional variables; returns the number of rows.

    ``attributes`` are those of variables, such as units. Every task writes files of at most ``max_rows``
    rows into a folder of this job's own. When all tasks are done, only the files that the tasks that
    counted report are moved to ``path``; a repeated task or a failed job leaves nothing there. ``mode`` is
    ``error`` (if there are array files already), ``append``, or ``overwrite`` (they are deleted just before
    the new ones appear).
    """
    if mode not in ("error", "append", "overwrite"):
        raise ValueError(f"unknown mode: {mode!r}")
    names, job = df.columns, uuid4().hex
    path = qualified(df.sparkSession, path)
    filesystem, inner = _locate(path)
    filesystem.create_dir(inner, recursive=True)
    old = [f.path for f in filesystem.get_file_info(fs.FileSelector(inner)) if f.base_name.endswith(".nc")]
    if old and mode == "error":
        raise FileExistsError(f"there are array files in {path}")
    staging = f"{inner}/_writing-{job}"
    filesystem.create_dir(staging)

    def write(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        filesystem, _ = _locate(path)
        kept: list[pa.RecordBatch] = []
        files: list[str] = []
        sizes: list[int] = []

        def flush() -> None:
            nonlocal kept
            table = pa.Table.from_batches(kept)
            empty = [n for n in names if table.column(n).null_count]
            if empty:
                raise ValueError(f"array files cannot hold NULL: {', '.join(empty)}")
            data = encode_file(dim, {n: table.column(n).to_numpy() for n in names}, attributes)
            name = f"{dim}s-{task.partitionId():06d}-{len(files):04d}.{task.taskAttemptId()}"
            with filesystem.open_output_stream(f"{staging}/{name}") as out:
                out.write(data)
            files.append(name)
            sizes.append(table.num_rows)
            kept = []

        for batch in arrow:
            while batch.num_rows:
                room = max_rows - sum(b.num_rows for b in kept)
                kept.append(batch.slice(0, room))
                batch = batch.slice(kept[-1].num_rows)
                if sum(b.num_rows for b in kept) == max_rows:
                    flush()
        if kept:
            flush()
        yield pa.RecordBatch.from_pydict({"name": pa.array(files, pa.string()), "rows": pa.array(sizes, pa.int64())})

    try:
        # A row for each file.
        written = df.mapInArrow(write, "name STRING, rows BIGINT").collect()
        if mode == "overwrite":
            for name in old:
                filesystem.delete_file(name)
        for row in written:
            target = row["name"].rpartition(".")[0]
            unique = f"{target}-{job[:8]}" if mode == "append" else target
            filesystem.move(f"{staging}/{row['name']}", f"{inner}/{unique}.nc")
    finally:
        filesystem.delete_dir(staging)
    return sum(row["rows"] for row in written)
