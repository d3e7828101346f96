"""Years and months of numeric time coordinates in climate calendars.

A time coordinate is a DOUBLE that counts units since a base moment in some calendar. The
functions here turn it into calendar fields with built-in arithmetic, so they stay inside
generated code, and can restrict a column to a range of years in a form that reaches the
Parquet reader.

Choices that are ours: coordinates are rounded to milliseconds, months are numbered 1 to 12, and
the default is days since 1970-01-01 in the standard calendar. NaN has no year or month, and neither has
a coordinate of more than ``RANGE_MS`` milliseconds (about 285,000 years) either way, such as infinity or
the usual fill values of array files.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridlake.sources.metadata import Metadata

log = logging.getLogger(__name__)

# Names of the calendars and of the units of time.
CALENDARS = {
    "standard": "standard",
    "gregorian": "standard",
    "proleptic_gregorian": "proleptic_gregorian",
    "noleap": "noleap",
    "365_day": "noleap",
    "all_leap": "all_leap",
    "366_day": "all_leap",
    "360_day": "360_day",
    "julian": "julian",
}
UNIT_MS = {
    "week": 604_800_000,
    "day": 86_400_000,
    "hour": 3_600_000,
    "minute": 60_000,
    "second": 1_000,
    "millisecond": 1,
}
UNIT_SHORT = {
    "d": "day",
    "h": "hour",
    "hr": "hour",
    "min": "minute",
    "s": "second",
    "sec": "second",
    "msec": "millisecond",
    "ms": "millisecond",
}
DAY_MS = UNIT_MS["day"]
RANGE_MS = 9_000_000_000_000_000
GREGORIAN_START = (1582, 10, 15)

UNITS_TEXT = re.compile(
    r"\s*(?P<unit>\w+)\s+since\s+(?P<year>[+-]?\d+)-(?P<month>\d+)-(?P<day>\d+)"
    r"(?:[T\s]+(?P<hour>\d+):(?P<minute>\d+)(?::(?P<second>\d+(?:\.\d+)?))?)?"
    r"\s*(?:Z|UTC|GMT|(?P<zone>[+-]\d{1,2}(?::?\d{2})?))?\s*",
    re.IGNORECASE,
)


@dataclass(frozen=True)
class TimeUnit:
    """What a time coordinate counts: ``unit_ms`` steps since a moment of a calendar.

    ``base_day`` is the calendar's number for the day of the base moment, ``base_ms`` the
    milliseconds into that day.
    """

    calendar: str
    unit_ms: int
    base_day: int
    base_ms: int

    @staticmethod
    def parse(calendar: str, units: str) -> TimeUnit:
        """From a calendar name and text such as ``days since 1850-01-01 00:00:00``."""
        name = CALENDARS.get(calendar.strip().lower())
        if name is None:
            raise ValueError(f"unknown calendar: {calendar!r}")
        found = UNITS_TEXT.fullmatch(units)
        if found is None:
            raise ValueError(f"not a time unit: {units!r}")
        unit = found["unit"].lower()
        unit = UNIT_SHORT.get(unit, unit.removesuffix("s"))
        if unit not in UNIT_MS:
            raise ValueError(f"unsupported unit of time: {found['unit']!r}")
        year, month, day = int(found["year"]), int(found["month"]), int(found["day"])
        if not 1 <= month <= 12 or not 1 <= day <= _month_length(name, year, month):
            raise ValueError(f"no such day in the {name} calendar: {units!r}")
        ms = int(found["hour"] or 0) * UNIT_MS["hour"] + int(found["minute"] or 0) * UNIT_MS["minute"]
        ms += round(float(found["second"] or 0) * 1000) - _zone_ms(found["zone"])
        days, ms = divmod(ms, DAY_MS)
        return TimeUnit(name, UNIT_MS[unit], day_number(name, year, month, day) + days, ms)

    def offset_ms(self, year: int, month: int = 1, day: int = 1) -> int:
        """Milliseconds from the base moment to the start of a day."""
        days = day_number(self.calendar, year, month, day) - self.base_day
        return days * DAY_MS - self.base_ms


def _zone_ms(zone: str | None) -> int:
    if not zone:
        return 0
    digits = zone[1:].replace(":", "")
    hours, minutes = (digits, "0") if len(digits) <= 2 else (digits[:-2], digits[-2:])
    ms = int(hours) * UNIT_MS["hour"] + int(minutes) * UNIT_MS["minute"]
    return -ms if zone[0] == "-" else ms


# --- day numbers of single dates, on the driver ----------------------------------------------
# Counting a year from March puts the leap day last, so that one formula serves every month.


def _march_year(year: int, month: int, day: int) -> tuple[int, int]:
    """Year starting in March and the day within it."""
    return year - (month < 3), (153 * ((month - 3) % 12) + 2) // 5 + day - 1


def day_number(calendar: str, year: int, month: int, day: int) -> int:
    """Consecutive number of a day; the starting point depends on the calendar.

    The two calendars that follow the Gregorian rules count from 1970-01-01.
    """
    if calendar == "360_day":
        return 360 * year + 30 * (month - 1) + day - 1
    march_year, march_day = _march_year(year, month, day)
    if calendar == "noleap":
        return 365 * march_year + march_day
    if calendar == "all_leap":
        return 366 * march_year + march_day
    julian = 365 * march_year + march_year // 4 + march_day
    if calendar == "julian":
        return julian
    if calendar == "standard" and (year, month, day) < GREGORIAN_START:
        return julian - JULIAN_1970
    gregorian = julian - march_year // 100 + march_year // 400
    return gregorian - GREGORIAN_1970


GREGORIAN_1970 = date(1970, 1, 1).toordinal() + 305  # days from 0000-03-01
JULIAN_1970 = 365 * 1969 + 1969 // 4 + _march_year(1969, 12, 19)[1]  # the same day, Julian style


def _month_length(calendar: str, year: int, month: int) -> int:
    if calendar == "360_day":
        return 30
    following = (year, month + 1, 1) if month < 12 else (year + 1, 1, 1)
    if calendar == "standard" and (year, month) == GREGORIAN_START[:2]:
        return 31
    return day_number(calendar, *following) - day_number(calendar, year, month, 1)


# --- columns -----------------------------------------------------------------------------------


def _day_sql(time: str, unit: TimeUnit) -> str:
    ms = f"FLOOR({time} * {unit.unit_ms}D + 0.5D)"
    return f"(FLOOR(({ms} + {unit.base_ms}L) / {DAY_MS}L) + ({unit.base_day}L))"


def _equal_years(days: int, n: str) -> tuple[str, str]:
    year = f"FLOOR({n} / {days})"
    return year, f"PMOD({n}, {days})"


def _julian_years(n: str) -> tuple[str, str]:
    year = f"FLOOR((4 * {n} + 3) / 1461)"
    return year, f"({n} - FLOOR(1461 * {year} / 4))"


def _from_march(years: Callable[[str], tuple[str, str]], n: str) -> tuple[str, str]:
    """Calendar year and month, from a rule for years that start in March."""
    march_year, march_day = years(n)
    march_month = f"FLOOR((5 * {march_day} + 2) / 153)"
    late = f"({march_month} >= 10)"  # January and February belong to the next year
    return f"({march_year} + INT({late}))", f"({march_month} + 3 - 12 * INT({late}))"


def _gregorian(n: str) -> tuple[str, str]:
    day = f"DATE_ADD(DATE'1970-01-01', CAST({n} AS INT))"
    return f"YEAR({day})", f"MONTH({day})"


def _standard(n: str) -> tuple[str, str]:
    start = day_number("proleptic_gregorian", *GREGORIAN_START)
    old, new = _from_march(_julian_years, f"({n} + {JULIAN_1970}L)"), _gregorian(n)
    return tuple(f"IF({n} >= {start}L, {b}, CAST({a} AS INT))" for a, b in zip(old, new))


FIELDS: dict[str, Callable[[str], tuple[str, str]]] = {
    "noleap": partial(_from_march, partial(_equal_years, 365)),
    "all_leap": partial(_from_march, partial(_equal_years, 366)),
    "360_day": lambda n: (f"FLOOR({n} / 360)", f"(FLOOR(PMOD({n}, 360) / 30) + 1)"),
    "julian": partial(_from_march, _julian_years),
    "proleptic_gregorian": _gregorian,
    "standard": _standard,
}


def _none_sql(time: str, unit: TimeUnit) -> str:
    """SQL text for whether a coordinate has no year: NaN counts as larger than any number."""
    return f"ABS({time} * {unit.unit_ms}D) > {RANGE_MS}D"


def year_sql(time: str, unit: TimeUnit) -> str:
    """SQL text for the calendar year of the SQL expression ``time``."""
    year, _ = FIELDS[unit.calendar](_day_sql(time, unit))
    return f"IF({_none_sql(time, unit)}, NULL, CAST({year} AS INT))"


def month_sql(time: str, unit: TimeUnit) -> str:
    """SQL text for the calendar month, 1 to 12, of the SQL expression ``time``."""
    _, month = FIELDS[unit.calendar](_day_sql(time, unit))
    return f"IF({_none_sql(time, unit)}, NULL, CAST({month} AS INT))"


def quoted(name: str) -> str:
    """A column name as SQL text, whatever it consists of."""
    return "`" + name.replace("`", "``") + "`"


def year_of(time: str, unit: TimeUnit) -> Column:
    """Calendar year of a time coordinate, given as a column name."""
    return F.expr(year_sql(f"DOUBLE({quoted(time)})", unit))


def month_of(time: str, unit: TimeUnit) -> Column:
    """Calendar month of a time coordinate, given as a column name."""
    return F.expr(month_sql(f"DOUBLE({quoted(time)})", unit))


def year_bounds(unit: TimeUnit, first: int, last: int) -> tuple[float, float]:
    """A half-open range of the coordinate with all moments from year ``first`` to year ``last``.

    It is wider than that by a millisecond at each end.
    """
    slack = 1.0 / unit.unit_ms
    low, high = ((unit.offset_ms(year) - 0.5) / unit.unit_ms for year in (first, last + 1))
    return low - slack, high + slack


def year_between(time: str, unit: TimeUnit, first: int, last: int) -> Column:
    """True from the start of year ``first`` to the end of year ``last``.

    This is a range on the coordinate itself, which Spark pushes into the Parquet scan and
    uses to skip row groups. A coordinate is in the range exactly if its millisecond is.
    """
    low, high = year_bounds(unit, first, last)
    column = F.col(quoted(time))
    near = (column >= low) & (column < high)
    return near & year_of(time, unit).between(first, last)


# --- metadata and SQL registration -------------------------------------------------------------

DEFAULT_UNIT = TimeUnit.parse("standard", "days since 1970-01-01 00:00:00")


def resolve_calendar(
    meta: Metadata | None, field: str, default: TimeUnit = DEFAULT_UNIT
) -> TimeUnit:
    """The time unit that metadata gives for a variable, or the default with a warning."""
    variable = meta.find_variable(field) if meta is not None else None
    if meta is None:
        problem = "there is no metadata"
    elif variable is None:
        problem = f"there is no variable {field!r}"
    elif variable.attributes.get("calendar") is None:
        problem = f"variable {field!r} has no calendar"
    elif variable.attributes["calendar"].strip().lower() not in CALENDARS:
        problem = f"calendar {variable.attributes['calendar']!r} is unknown"
    elif variable.units is None:
        problem = f"variable {field!r} has no units"
    else:
        return TimeUnit.parse(variable.attributes["calendar"], variable.units)
    log.warning("%s; using the default time unit", problem)
    return default


def register_calendar_functions(
    spark: SparkSession,
    meta: Metadata | None,
    field: str,
    suffix: str = "",
    default: TimeUnit = DEFAULT_UNIT,
) -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    """Make ``yearOf`` and ``monthOf`` (plus ``suffix``) usable in SQL for a variable.

    They are SQL functions that Spark replaces by their bodies, not calls into Python. Returns
    the matching pair of functions from a column name to a Column.
    """
    unit = resolve_calendar(meta, field, default)
    for name, body in (("yearOf", year_sql), ("monthOf", month_sql)):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{suffix}(x DOUBLE) RETURNS INT "
            f"RETURN {body('x', unit)}"
        )
    return partial(year_of, unit=unit), partial(month_of, unit=unit)
