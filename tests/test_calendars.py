from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from gridlake.functions.calendar import (
    CALENDARS,
    DEFAULT_UNIT,
    TimeUnit,
    day_number,
    month_of,
    register_calendar_functions,
    resolve_calendar,
    year_between,
    year_of,
)
from gridlake.operators.stats import period_stats
from gridlake.sources.dataset import load_dataset, save_dataset
from gridlake.sources.metadata import (
    Metadata,
    Variable,
    attributes_frame,
    metadata_frame,
    read_metadata,
    variable_info,
)

NAMES = sorted(set(CALENDARS.values()))


def fields(spark, unit, values):
    df = spark.createDataFrame([(float(v),) for v in values], "t DOUBLE")
    return [tuple(r) for r in df.select(year_of("t", unit), month_of("t", unit)).collect()]


def month_lengths(calendar, year):
    if calendar == "360_day":
        return [30] * 12
    leap = {
        "noleap": False,
        "all_leap": True,
        "julian": year % 4 == 0,
        "proleptic_gregorian": year % 4 == 0 and (year % 100 != 0 or year % 400 == 0),
    }
    leap["standard"] = leap["julian"] if year <= 1582 else leap["proleptic_gregorian"]
    lengths = [31, 29 if leap[calendar] else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if calendar == "standard" and year == 1582:
        lengths[9] = 21
    return lengths


@pytest.mark.parametrize("calendar", NAMES)
def test_every_month_end(spark, calendar):
    """Walk through 500 years, month by month, from a known first day."""
    unit = TimeUnit.parse(calendar, "days since 1500-01-01")
    values, expected, at = [], [], 0
    for year in range(1500, 2000):
        for month, length in enumerate(month_lengths(calendar, year), start=1):
            values += [at, at + length - 1, at + length - 0.001]
            expected += [(year, month)] * 3
            at += length
    assert fields(spark, unit, values) == expected


@pytest.mark.parametrize("calendar", NAMES)
def test_before_the_base(spark, calendar):
    unit = TimeUnit.parse(calendar, "days since 0003-03-01 12:00")
    assert fields(spark, unit, [0, -0.5, -0.501, -59.6, -600]) [:2] == [(3, 3), (3, 3)]
    assert fields(spark, unit, [-0.501]) == [(3, 2)]
    assert fields(spark, unit, [-400 * 370])[0][0] < 0


def test_day_numbers_follow_the_standard_library():
    for days in range(0, 800_000, 997):
        d = date(1, 1, 1) + timedelta(days=days)
        assert day_number("proleptic_gregorian", d.year, d.month, d.day) == (d - date(1970, 1, 1)).days
    assert day_number("standard", 1582, 10, 15) - day_number("standard", 1582, 10, 4) == 1


@pytest.mark.parametrize(
    ("units", "value"),
    [
        ("weeks since 1999-12-01", 31 / 7),
        ("days since 1999-12-01", 31),
        ("hours since 1999-12-31 18:30:00", 5.5),
        ("minutes since 1999-12-31T23:00", 60),
        ("seconds since 1999-12-31 23:59:59.5", 0.5),
        ("msec since 1999-12-31 23:59:59", 1000),
        ("hours since 2000-01-01 02:00 +02:00", 0),
        ("hours since 1999-12-31 19:00 -0500", 0),
        ("h since 1999-12-31 23:00:00Z", 1),
    ],
)
def test_units(spark, units, value):
    unit = TimeUnit.parse("gregorian", units)
    step = 1.0 / unit.unit_ms
    assert fields(spark, unit, [value, value - step]) == [(2000, 1), (1999, 12)]


@pytest.mark.parametrize(
    ("calendar", "units"),
    [
        ("lunar", "days since 2000-01-01"),
        ("standard", "months since 2000-01-01"),
        ("standard", "years since 2000-01-01"),
        ("standard", "days after 2000-01-01"),
        ("noleap", "days since 2000-02-29"),
        ("360_day", "days since 2000-01-31"),
        ("standard", "days since 2000-13-01"),
    ],
)
def test_bad_units(calendar, units):
    with pytest.raises(ValueError):
        TimeUnit.parse(calendar, units)


def test_no_year_of_nan(spark):
    assert fields(spark, DEFAULT_UNIT, [float("nan")]) == [(None, None)]


def test_fields_stay_in_generated_code(spark):
    unit = TimeUnit.parse("standard", "days since 1850-01-01")
    df = spark.range(10).select(F.col("id").cast("double").alias("t"))
    df = df.select(year_of("t", unit).alias("y"), month_of("t", unit).alias("m"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "*(1) Project" in plan


@pytest.mark.parametrize("calendar", NAMES)
def test_year_between(spark, calendar, tmp_path):
    path = str(tmp_path / "times")
    spark.range(-2000, 4000).select((F.col("id") / 4).alias("t")).write.parquet(path)
    unit = TimeUnit.parse(calendar, "days since 2000-01-01")
    df = spark.read.parquet(path)
    chosen = df.where(year_between("t", unit, 2000, 2001))
    expected = df.where(year_of("t", unit).isin(2000, 2001))
    assert chosen.count() == expected.count() > 0
    assert chosen.exceptAll(expected).isEmpty()
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan and "LessThan(t," in plan


def test_resolve_and_register(spark, caplog):
    meta = Metadata(
        (
            Variable("time", "days since 2000-01-01", ("time",), {"calendar": "360_day"}),
            Variable("bare", "K"),
            Variable("odd", "days since 2000-01-01", (), {"calendar": "lunar"}),
            Variable("unitless", None, (), {"calendar": "noleap"}),
        )
    )
    assert resolve_calendar(meta, "time").calendar == "360_day"
    for given, field in ((None, "time"), (meta, "gone"), (meta, "bare"), (meta, "odd"), (meta, "unitless")):
        caplog.clear()
        assert resolve_calendar(given, field) == DEFAULT_UNIT
        assert "default time unit" in caplog.text
    other = TimeUnit.parse("noleap", "days since 1900-01-01")
    assert resolve_calendar(None, "time", default=other) == other

    year, month = register_calendar_functions(spark, meta, "time")
    register_calendar_functions(spark, None, "time", suffix="_plain", default=other)
    got = spark.sql("SELECT yearOf(59D), monthOf(60D), yearOf_plain(365D), monthOf_plain(31D)").first()
    assert tuple(got) == (2000, 3, 1901, 2)
    both = spark.range(1).select(F.lit(360.0).alias("t")).select(year("t"), month("t")).first()
    assert tuple(both) == (2001, 1)


def test_period_stats(spark):
    df = spark.createDataFrame([(0.0, 1.0), (364.0, 3.0), (365.0, 5.0)], "t DOUBLE, v DOUBLE")
    unit = TimeUnit.parse("noleap", "days since 2000-01-01")
    rows = period_stats(df, unit, "t", "v", monthly=False).orderBy("year").collect()
    assert [tuple(r) for r in rows] == [(2000, 2, 2.0, 1.0, 3.0), (2001, 1, 5.0, 5.0, 5.0)]
    rows = period_stats(df, unit, "t", "v").orderBy("year", "month").collect()
    assert [(r.year, r.month, r["count"]) for r in rows] == [(2000, 1, 1), (2000, 12, 1), (2001, 1, 1)]


# --- metadata and datasets ----------------------------------------------------------------------

META = Metadata(
    (
        Variable("time", "days since 1850-01-01", ("time",), {"calendar": "noleap"}),
        Variable("tas", "K", ("time", "lat", "lon"), {"long_name": "temperature"}),
    )
)


def test_read_metadata(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(META.to_json())
    assert read_metadata(spark, str(tmp_path)) == META
    frame = metadata_frame(spark, str(tmp_path / "metadata.json"))
    assert tuple(variable_info(frame, "time").first()) == ("time", "days since 1850-01-01", "noleap")
    assert variable_info(frame, "tas").first().calendar is None
    assert variable_info(frame, "gone").isEmpty()
    assert ("tas", "long_name", "temperature") in [tuple(r) for r in attributes_frame(frame).collect()]
    # The text may be laid out over several lines.
    (tmp_path / "metadata.json").write_text(META.to_json().replace(", ", ",\n  "))
    assert read_metadata(spark, str(tmp_path)) == META


def test_dataset_with_sidecar(spark, tmp_path):
    path = str(tmp_path / "data")
    df = spark.range(5).select(F.col("id").cast("double").alias("time"))
    save_dataset(df, META, path)
    meta, loaded = load_dataset(spark, path)
    assert meta == META and loaded.count() == 5
    assert meta.find_variable("time").attributes["calendar"] == "noleap"

    save_dataset(df, None, path, mode="overwrite")
    assert load_dataset(spark, path)[0] is None

    bare = str(tmp_path / "bare")
    df.write.parquet(bare)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        load_dataset(spark, bare)
    (tmp_path / "bare.meta").write_text("")
    assert load_dataset(spark, bare)[0] is None


@pytest.mark.parametrize("calendar", ["standard", "proleptic_gregorian", "julian", "noleap", "all_leap", "360_day"])
def test_fill_values_and_infinities_have_no_year(spark, calendar):
    unit = TimeUnit.parse(calendar, "days since 1850-01-01")
    values = [9.96921e36, -9.96921e36, 1e20, float("inf"), float("-inf"), 2e8, None]
    df = spark.createDataFrame([(v,) for v in values], "t double")
    assert {tuple(r) for r in df.select(year_of("t", unit), month_of("t", unit)).collect()} == {(None, None)}


def test_names_are_not_read_as_sql(spark):
    unit = TimeUnit.parse("noleap", "days since 2000-01-01")
    df = spark.createDataFrame([(1000.0, 999.0, 400.0)], "t double, x double, `t-x` double")
    assert df.select(year_of("t-x", unit)).first()[0] == 2001
    assert df.where(year_between("t-x", unit, 2001, 2001)).count() == 1


def test_damaged_metadata_raises(spark, tmp_path):
    (tmp_path / "metadata.json").write_text('{"variables": [{"name": "t", "units"')
    with pytest.raises(Exception):
        read_metadata(spark, str(tmp_path))
    (tmp_path / "metadata.json").write_text("{}")
    with pytest.raises(ValueError):
        read_metadata(spark, str(tmp_path))
