"""Dataset metadata: variables with units, dimensions and attributes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = (
    "variables ARRAY<STRUCT<name: STRING, units: STRING, dims: ARRAY<STRING>, "
    "attributes: MAP<STRING, STRING>>>"
)


@dataclass(frozen=True)
class Variable:
    name: str
    units: str | None = None
    dims: tuple[str, ...] = ()
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Metadata:
    variables: tuple[Variable, ...] = ()

    def find_variable(self, name: str) -> Variable | None:
        return next((v for v in self.variables if v.name == name), None)

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def metadata_frame(spark: SparkSession, path: str) -> DataFrame:
    """A metadata file as a DataFrame with one row, or none if the file is empty.

    A damaged or truncated file fails the query that reads it.
    """
    return spark.read.schema(METADATA_SCHEMA).options(multiLine=True, mode="FAILFAST").json(path)


def variables_frame(metadata: DataFrame) -> DataFrame:
    """One row per variable: ``name, units, dims, attributes``."""
    return metadata.select(F.inline("variables"))


def attributes_frame(metadata: DataFrame) -> DataFrame:
    """One row per variable and attribute: ``variable, attribute, value``."""
    return variables_frame(metadata).select(
        F.col("name").alias("variable"), F.explode("attributes").alias("attribute", "value")
    )


def variable_info(metadata: DataFrame, name: str) -> DataFrame:
    """Units and calendar of one variable: ``name, units, calendar``."""
    return (
        variables_frame(metadata)
        .where(F.col("name") == name)
        .select("name", "units", F.col("attributes")["calendar"].alias("calendar"))
    )


def first_metadata(metadata: DataFrame) -> Metadata | None:
    """The first record as an object, or ``None``; metadata is small by nature."""
    row = metadata.first()
    if row is None:
        return None
    if row.variables is None:
        raise ValueError("the metadata has no list of variables")
    return Metadata(
        tuple(
            Variable(v.name, v.units, tuple(v.dims or ()), dict(v.attributes or {}))
            for v in row.variables
        )
    )


def metadata_from_record(record: dict | None) -> Metadata | None:
    """A record with the fields of ``METADATA_SCHEMA`` as an object; other fields are ignored."""
    if record is None:
        return None
    if record.get("variables") is None:
        raise ValueError("the metadata has no list of variables")
    return Metadata(
        tuple(
            Variable(
                v["name"],
                v.get("units"),
                tuple(v.get("dims") or ()),
                {k: str(a) for k, a in (v.get("attributes") or {}).items() if a is not None},
            )
            for v in record["variables"]
        )
    )


def read_metadata(spark: SparkSession, directory: str) -> Metadata | None:
    """The ``metadata.json`` of a directory of array files."""
    return first_metadata(metadata_frame(spark, f"{directory.rstrip('/')}/metadata.json"))
