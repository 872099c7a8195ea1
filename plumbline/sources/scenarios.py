"""Forcing, temperature and control series of a scenario, from a folder of files.

A scenario's kind (``forcing.kind_of``) picks its loader. File names are patterns under the root
and parameters of ``Layout``; ``{scenario}`` stands for the scenario's name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeseries as ts
from . import files, forcing


@dataclass(frozen=True)
class Layout:
    #: One CSV with a column for each variable, or one for the anthropogenic variables and one with natural members.
    table: str = "{scenario}/ERF_[A-Z]*.csv"
    anthropogenic: str = "{scenario}/ERF_anthro*.csv"
    natural: str = "{scenario}/ERF_natural*.csv"
    #: NetCDF ensembles of observed forcing, the name of their ensemble dimension, and of pathways (year, pathway, member).
    netcdf: str = "{scenario}/ERF/*.nc"
    ensemble: str = "ensemble"
    pathways: str = "observed_SSP-extension/ERF/*.nc"
    temperature: str = "{scenario}/ts_*.csv"
    measured: str = "{scenario}/Temp/*/*ensemble_series*.csv"
    control: str = "piControl"
    parameters: str = "parameters.csv"
    time: str = "year"
    #: The scenario whose measurements pathways are attributed with, and the headers of measured members.
    measured_scenario: str = "observed-2024"
    members: str = "Realization"


def _at(root: str, pattern: str, scenario: str) -> str:
    return f"{root}/{pattern.format(scenario=scenario)}"


def _variables(spark: SparkSession, path: str, time: str) -> DataFrame:
    """variable, ensemble, t, value of a CSV with a column for each variable."""
    return files.read_wide_csv(spark, path, time, name="variable").withColumn("ensemble", F.lit("single")).select("variable", "ensemble", "t", "value")


#: The names of the variables in files of observed forcing (whose total is left out) and of pathways.
OBSERVED = {"wmghg": "GHG", "other_ant": "OHF", "natural": "Nat"}
PATHWAYS = {v: v for v in ("ghg", "natural", "anthro", "total", "aerosol", "other")}


def _observed(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """variable, ensemble, t, value of a file with an ensemble dimension and a time."""
    raw = files.read_netcdf(spark, path, OBSERVED)
    (time,) = [c for c in raw.columns if c not in ("variable", layout.ensemble, "value")]
    return raw.select("variable", F.concat(F.lit("ens"), F.col(layout.ensemble).cast("string")).alias("ensemble"), F.floor(F.col(f"`{time}`").cast("double")).cast("int").alias("t"), "value")


def _natural_members(spark: SparkSession, root: str, scenario: str, layout: Layout) -> DataFrame:
    """Natural members, and the single anthropogenic series for each of them."""
    natural = files.read_wide_csv(spark, _at(root, layout.natural, scenario), layout.time, name="ensemble").withColumn("variable", F.lit("Nat")).select("variable", "ensemble", "t", "value")
    return natural.unionByName(forcing.replicate(_variables(spark, _at(root, layout.anthropogenic, scenario), layout.time), natural))


def load_forcing(spark: SparkSession, root: str, scenario: str, wanted: list[str], member: str = "all", layout: Layout = Layout()) -> DataFrame:
    """variable, ensemble, t, value of the wanted variables; a source with one member serves any of them."""
    kind = forcing.kind_of(scenario)
    if kind == "smile" or kind == "noresm" and scenario.endswith("Const"):
        raw = _variables(spark, _at(root, layout.table, scenario), layout.time)
    elif kind == "noresm":
        raw = _natural_members(spark, root, scenario, layout)
    elif kind == "ssp":
        raw = files.read_netcdf(spark, _at(root, layout.pathways, scenario), PATHWAYS, ["year", "scenario", "ensemble"])
        raw = forcing.ssp(raw.withColumn("ensemble", F.col("ensemble").cast("string")), scenario.rpartition("-")[2])
    else:
        raw = _observed(spark, _at(root, layout.netcdf, scenario), layout)
    whole = forcing.complete(raw, wanted)
    alone = member == "all" or whole.select("ensemble").distinct().limit(2).count() == 1
    return whole if alone else forcing.member(whole, member)


def load_temperature(spark: SparkSession, root: str, scenario: str, era: tuple[int, int], member: str = "all", layout: Layout = Layout()) -> DataFrame:
    """member, t, value, less the mean over the era of the members' median. Pathways take the measured series."""
    kind = forcing.kind_of(scenario)
    if kind in ("observed", "ssp"):
        raw = files.read_wide_csv(spark, _at(root, layout.measured, scenario if kind == "observed" else layout.measured_scenario), "Time", layout.members)
    else:
        raw = files.read_wide_csv(spark, _at(root, layout.temperature, scenario), layout.time)
    if member != "all":
        raw = raw.filter(F.col("member") == member)
    span = raw.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    if span.a is None:
        raise ValueError(f"no temperature member {member!r}")
    if not (span.a <= era[0] and era[1] <= span.b):
        raise ValueError(f"the era {era} lies outside the temperatures of {span.a}-{span.b}")
    return ts.baseline_median(raw, *era)


def load_control(spark: SparkSession, root: str, rows: int, baseline_rows: int, short=(3, 0.3, 0.06), long=(30, 0.1), layout: Layout = Layout()) -> DataFrame:
    """member, t (from 0), value of the half-overlapping control slices of ``rows`` years whose running means stay within the limits."""
    keys = ["model", "experiment", "member", "slice_start"]
    slices = ts.segments(files.read_control_text(spark, f"{root}/{layout.control}"), keys[:3], rows, baseline_rows)
    kept = slices.join(ts.in_range(slices, keys, short, long), keys, "left_semi")
    return kept.select(F.concat_ws("-", *keys).alias("member"), "t", "value")
