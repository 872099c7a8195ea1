"""NetCDF files of the classic formats, and the scenarios that are read from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import config
from plumbline.sources import files, netcdf, scenarios

from . import classic

YEARS, MEMBERS = np.arange(1850, 1890), np.arange(1, 13)


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    netcdf.register(spark)


def ensemble(seed=1):
    return np.random.default_rng(seed).normal(size=(len(YEARS), len(MEMBERS)))


def forcing_file(path, version=1, record=False):
    time = {"year": None if record else len(YEARS), "ensemble": len(MEMBERS)}
    own = {v: ensemble(i).astype(kind) for i, (v, kind) in enumerate({"wmghg": "f8", "other_ant": "f4", "natural": "f8", "total": "f8"}.items())}
    classic.write(path, time, [("year", ["year"], YEARS.astype("f8") + 0.5, {"units": "years"}), ("ensemble", ["ensemble"], MEMBERS.astype("i4"), {}), *((v, ["year", "ensemble"], a, {}) for v, a in own.items())], version)
    return own


@pytest.mark.parametrize(("version", "record"), [(1, False), (2, True), (5, True), (5, False)])
def test_values(spark, tmp_path, version, record):
    own = forcing_file(tmp_path / "a.nc", version, record)
    got = spark.read.format(netcdf.NAME).load(str(tmp_path / "a.nc"))
    assert got.dtypes == [("variable", "string"), ("year", "double"), ("ensemble", "bigint"), ("value", "double")]
    want = {(v, y + 0.5, int(m)): float(a[i, j]) for v, a in own.items() for i, y in enumerate(YEARS) for j, m in enumerate(MEMBERS)}
    assert {(r.variable, r.year, r.ensemble): r.value for r in got.collect()} == want


def test_four_tasks(spark, tmp_path):
    forcing_file(tmp_path / "a.nc")
    got = spark.read.format(netcdf.NAME).option("variables", "natural").option("rows", 10 * len(MEMBERS)).load(str(tmp_path / "a.nc"))
    assert got.rdd.getNumPartitions() == 4 and got.count() == len(YEARS) * len(MEMBERS)


def test_filters_are_pushed(spark, tmp_path):
    own = forcing_file(tmp_path / "a.nc", 2, True)
    got = spark.read.format(netcdf.NAME).option("rows", 1).load(str(tmp_path / "a.nc")).filter("variable = 'natural' and year > 1860 and year <= 1862.5 and ensemble = 3")
    assert got.rdd.getNumPartitions() == len(YEARS)  # those of one variable
    assert {r.year: r.value for r in got.collect()} == {y + 0.5: own["natural"][y - 1850, 2] for y in (1860, 1861, 1862)}
    assert spark.read.format(netcdf.NAME).load(str(tmp_path / "a.nc")).filter("variable = 'none'").count() == 0
    assert spark.read.format(netcdf.NAME).load(str(tmp_path / "a.nc")).filter("variable in ('natural', 'total') and year in (1850.5, 1889.5)").count() == 4 * len(MEMBERS)


@pytest.mark.parametrize("record", [False, True])
def test_only_asked_bytes_are_read(tmp_path, monkeypatch, record):
    forcing_file(tmp_path / "a.nc", 2, record)
    opened, read = netcdf._opened, []

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read_at(self, n, at):
            read.append((at, n))
            return self.file.read_at(n, at)

    monkeypatch.setattr(netcdf, "_opened", lambda store, name: (lambda file, head: (Counted(file), head))(*opened(store, name)))
    reader = netcdf.NetcdfReader(str(tmp_path / "a.nc"), ["natural"], ("year", "ensemble"), 10 * len(MEMBERS))
    parts = reader.partitions()
    assert len(parts) == 4 and not read  # headers only
    assert sum(len(b) for b in reader.read(parts[1])) == 10 * len(MEMBERS)
    assert sum(n for _, n in read) == 8 * 10 * len(MEMBERS) + 8 * 10 + 4 * len(MEMBERS)  # its values, its years and the members
    read.clear()
    reader.kept = [netcdf.EqualTo(("year",), 1700.5)]
    assert list(reader.read(parts[1])) == [] and sum(n for _, n in read) == 8 * 10


def test_missing_and_packed(spark, tmp_path):
    classic.write(tmp_path / "m.nc", {"x": 4}, [("a", ["x"], np.array([1, 2, -1, 4], "i2"), {"_FillValue": np.array([-1], "i2"), "scale_factor": np.array([0.5]), "add_offset": np.array([10.0])}), ("b", ["x"], np.array([1, np.nan, 9.969209968386869e36, 3]), {})])
    got = spark.read.format(netcdf.NAME).load(str(tmp_path / "m.nc"))
    assert [r.value for r in got.filter("variable = 'a'").orderBy("x").collect()] == [10.5, 11.0, None, 12.0]
    assert [(r.x, r.value) for r in got.filter("variable = 'b'").orderBy("x").collect()] == [(0, 1.0), (1, None), (2, None), (3, 3.0)]
    assert files.read_netcdf(spark, str(tmp_path / "m.nc"), {"b": "B"}, ["t"]).orderBy("t").collect() == [("B", 0, 1.0), ("B", 3, 3.0)]
    with pytest.raises(ValueError):
        files.read_netcdf(spark, str(tmp_path / "m.nc"), {"b": "B"}, ["t", "u"])


def test_other_files(spark, tmp_path):
    (tmp_path / "h.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    (tmp_path / "t.nc").write_bytes(b"CDF\x01\0\0")
    (tmp_path / "x.nc").write_bytes(b"year,value\n")
    forcing_file(tmp_path / "a.nc")
    for name, said in (("h.nc", "HDF5"), ("t.nc", "ends"), ("x.nc", "classic"), ("no*.nc", "no")):
        with pytest.raises(Exception, match=said):
            spark.read.format(netcdf.NAME).load(str(tmp_path / name)).count()
    with pytest.raises(Exception, match="no variables"):
        spark.read.format(netcdf.NAME).option("variables", "none").load(str(tmp_path / "a.nc")).count()
    forcing_file(tmp_path / "b1.nc")
    forcing_file(tmp_path / "b2.nc")
    assert spark.read.format(netcdf.NAME).option("variables", "total").load(str(tmp_path / "b?.nc")).count() == 2 * len(YEARS) * len(MEMBERS)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("netcdf")
    for name in ("observed-2024/ERF", "observed-2024/Temp/x", "observed_SSP-extension/ERF"):
        (at / name).mkdir(parents=True)
    forcing_file(at / "observed-2024/ERF/ERF_1750-2024.nc")
    paths = np.array([list("ssp119"), list("ssp245")], "S1")
    own = {v: np.random.default_rng(i).normal(size=(len(YEARS), 2, 3)) for i, v in enumerate(scenarios.PATHWAYS)}
    classic.write(at / "observed_SSP-extension/ERF/ssp.nc", {"timebounds": len(YEARS), "scenario": 2, "config": 3, "len": 6}, [("timebounds", ["timebounds"], YEARS + 0.5, {}), ("scenario", ["scenario", "len"], paths, {}), ("config", ["config"], np.array([7, 8, 9], "i4"), {}), *((v, ["timebounds", "scenario", "config"], a, {}) for v, a in own.items())], 2)
    (at / "observed-2024/Temp/x/T_ensemble_series.csv").write_text("Time,Realization 1,Realization 2,Lower\n" + "".join(f"{y},{0.01 * (y - 1850)},{0.012 * (y - 1850)},0\n" for y in YEARS))
    return str(at), own


def test_observed_scenario(spark, root):
    got = scenarios.load_forcing(spark, root[0], "observed-2024", ["GHG", "Nat", "OHF"])
    assert {(r.variable, r.ensemble) for r in got.select("variable", "ensemble").distinct().collect()} == {(v, f"ens{m}") for v in ("GHG", "Nat", "OHF") for m in MEMBERS}
    one = got.filter("variable = 'GHG' and ensemble = 'ens3' and t = 1855").first()
    assert one.value == ensemble(0)[5, 2]
    total = scenarios.load_forcing(spark, root[0], "observed-2024", ["Tot"], "ens3").filter("t = 1855").collect()
    assert len(total) == 1 and np.isclose(total[0].value, ensemble(0)[5, 2] + ensemble(1).astype("f4")[5, 2] + ensemble(2)[5, 2])
    settings = config.RunConfig(scenario="observed-2024", preindustrial=(1850, 1859), regress=(1850, 1889))
    temperature = scenarios.load_temperature(spark, root[0], settings.scenario, settings.preindustrial)
    assert temperature.count() == 2 * len(YEARS)


def test_pathway(spark, root):
    at, own = root
    got = scenarios.load_forcing(spark, at, "observed-SSP245", ["GHG", "Nat", "OHF"])
    of = lambda v: got.filter((F.col("variable") == v) & (F.col("ensemble") == "8") & (F.col("t") == 1860)).first().value
    assert of("GHG") == own["ghg"][10, 1, 1] and of("Nat") == own["natural"][10, 1, 1]
    assert np.isclose(of("OHF"), own["aerosol"][10, 1, 1] + own["other"][10, 1, 1])
    assert got.count() == 3 * 3 * len(YEARS)
