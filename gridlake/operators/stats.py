"""Summaries: zeros and checksums per source, period statistics over a time coordinate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlake.functions.calendar import TimeUnit, month_of, year_of


def count_zeros(df: DataFrame, value: str = "v", by: str | Sequence[str] = "file") -> DataFrame:
    """Number of zeros of a variable per source file (or other grouping)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.count_if(F.col(value) == 0).alias("zeros"))


def filter_valid(df: DataFrame, value: str, at_least: float = 0) -> DataFrame:
    """Rows that are not marked invalid by a negative value."""
    return df.where(F.col(value) >= at_least)


def checksum(df: DataFrame, value: str = "v", by: str | Sequence[str] = "file") -> DataFrame:
    """Number of values and their sum per source."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.sum(value).alias("sum")
    )


def total_checksum(df: DataFrame, value: str = "v", by: str | Sequence[str] = "file") -> DataFrame:
    """One row: count and sum over the sources whose sum is valid, and how many those are."""
    return filter_valid(checksum(df, value, by), "sum").agg(
        F.count(F.lit(1)).alias("sources"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("count"),
        F.sum("sum").alias("sum"),
    )


def period_stats(
    df: DataFrame,
    unit: TimeUnit,
    time: str,
    value: str,
    by: Sequence[str | Column] = (),
    monthly: bool = True,
) -> DataFrame:
    """Count, mean, minimum and maximum of ``value`` per year (and month) of a time coordinate."""
    period = [year_of(time, unit).alias("year")]
    if monthly:
        period.append(month_of(time, unit).alias("month"))
    return df.groupBy(*by, *period).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
