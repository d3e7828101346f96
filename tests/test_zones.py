import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions.calendar import TimeUnit, year_between, year_bounds
from gridlake.sources import netcdf
from gridlake.sources.netcdf import encode_file, read_netcdf
from gridlake.sources.zones import read_netcdf_between, zone_map, zones_between

UNITS = {"time": {"units": "days since 2000-01-01", "calendar": "noleap"}}


@pytest.fixture
def folder(tmp_path):
    """Three files of ascending times, the last in units of its own, and one without order."""
    rng = np.random.default_rng(0)
    for k in range(3):
        shift = {"time": {"units": "hours since 2002-01-01", "calendar": "noleap"}} if k == 2 else UNITS
        time = np.arange(365.0) + (365 * k if k < 2 else 0)
        columns = {"time": time * 24 if k == 2 else time, "v": np.arange(365, dtype=np.int32) + np.int32(1000 * k)}
        (tmp_path / f"{k}.nc").write_bytes(encode_file("time", columns, shift))
    mixed = {"time": rng.permutation(900)[:300] + 0.25, "v": np.arange(300, dtype=np.int32)}
    (tmp_path / "mixed.nc").write_bytes(encode_file("time", mixed, UNITS))
    return tmp_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_zone_map(spark, folder):
    got = rows(zone_map(spark, str(folder), "time", step=100).select("file", "records", "first", "end", "low", "high", "nan", "ascending"))
    assert len(got) == 3 * 4 + 3
    by_file = {k: [r for r in got if r[0].endswith(f"{k}.nc")] for k in ("0", "1", "2", "mixed")}
    for k in range(3):
        zones = sorted(by_file[str(k)], key=lambda r: r[2])
        assert [r[2:6] for r in zones] == [(a, min(a + 100, 365), 365.0 * k + a, 365.0 * k + min(a + 100, 365) - 1) for a in range(0, 365, 100)]
        assert all(r[1] == 365 and r[6:] == (False, True) for r in zones)
    assert not any(r[7] for r in by_file["mixed"])


@pytest.mark.parametrize("low, high", [(0.0, 50.0), (300.0, 420.0), (730.0, 731.0), (-9.0, -1.0), (-1.0, 5000.0), (1094.0, 1095.0)])
@pytest.mark.parametrize("split", [1 << 20, 700])
def test_same_rows_as_the_whole_scan(spark, folder, low, high, split):
    zones = zone_map(spark, str(folder), "time", step=64)
    whole = read_netcdf(spark, str(folder), ["v"], coordinates=True).where((F.col("time") >= low) & (F.col("time") < high))
    got = read_netcdf_between(spark, str(folder), zones, "time", low, high, ["v"], split_bytes=split)
    assert got.columns == whole.columns
    assert rows(got) == rows(whole)


def test_ranges_outside_are_not_read(spark, folder):
    zones = zone_map(spark, str(folder), "time", step=50)
    hit = zones_between(zones.where("ascending"), 100, 130).collect()
    assert [(r["file"].rsplit("/", 1)[-1], r["first"], r["end"]) for r in hit] == [("0.nc", 100, 150)]
    # Files that cannot be read any more do no harm if they are outside.
    zones = spark.createDataFrame(zones.collect(), zones.schema)
    (folder / "2.nc").write_bytes(b"nothing")
    got = read_netcdf_between(spark, str(folder), zones.where("file not like '%mixed%'"), "time", 100, 130, ["v"])
    assert got.count() == 30
    whole = read_netcdf(spark, str(folder), ["v"], coordinates=True)
    with pytest.raises(Exception, match="2.nc|not|header"):
        whole.collect()


def test_years(spark, folder):
    unit = TimeUnit.parse("noleap", UNITS["time"]["units"])
    zones = zone_map(spark, str(folder), "time")
    low, high = year_bounds(unit, 2001, 2001)
    got = read_netcdf_between(spark, str(folder), zones, "time", low, high, ["v"]).where(year_between("time", unit, 2001, 2001))
    whole = read_netcdf(spark, str(folder), ["v"], coordinates=True).where(year_between("time", unit, 2001, 2001))
    assert got.count() > 365 and rows(got) == rows(whole)


def test_nan_and_missing_values(spark, tmp_path):
    time = np.array([np.nan, 1.0, 2.0, np.nan, np.nan, 5.0, -999.0, 7.0])
    attributes = {"time": {**UNITS["time"], "_FillValue": -999.0}}
    (tmp_path / "a.nc").write_bytes(encode_file("time", {"time": time, "v": np.arange(8, dtype=np.int32)}, attributes))
    zones = zone_map(spark, str(tmp_path), "time", step=2)
    got = sorted((r["first"], r["low"], r["high"], r["nan"]) for r in zones.collect())
    assert got == [(0, 1.0, 1.0, True), (2, 2.0, 2.0, True), (4, 5.0, 5.0, True), (6, -999.0, 7.0, False)]
    for low, high in ((0.0, 3.0), (4.0, 8.0), (6.5, 9.0)):
        whole = read_netcdf(spark, str(tmp_path), ["v"], coordinates=True).where((F.col("time") >= low) & (F.col("time") < high))
        assert rows(read_netcdf_between(spark, str(tmp_path), zones, "time", low, high, ["v"])) == rows(whole)
    assert [(r["first"], r["end"]) for r in zones_between(zones, 6.0).collect()] == [(0, 8)]


def test_arguments(spark, folder):
    with pytest.raises(ValueError, match="no such variable"):
        zone_map(spark, str(folder), "lat")
    with pytest.raises(ValueError, match="records"):
        zone_map(spark, str(folder), "time", step=0)
    assert zones_between(zone_map(spark, str(folder), "time"), None, None).count() == 4
    assert netcdf.list_files(str(folder))
