"""Forcing sources by scenario, brought to rows (scenario, variable, ensemble, t, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components of the variables that a source may have to sum.
SUMS = {"Ant": ["GHG", "OHF"], "Tot": ["GHG", "OHF", "Nat"]}
KINDS = {"observed-SSP": "ssp", "observed-20": "observed", "SMILE_ESM": "smile", "NorESM": "noresm"}


def kind_of(scenario: str) -> str:
    for part, kind in KINDS.items():
        if part in scenario:
            return kind
    raise ValueError(f"unknown scenario {scenario!r}")


def complete(forcing: DataFrame, wanted: list[str], sums: dict[str, list[str]] = SUMS) -> DataFrame:
    """The wanted variables: as they are, or summed from their components where the source lacks them."""
    needed = {*wanted, *(p for v in wanted for p in sums.get(v, []))}
    have = {r.variable for r in forcing.filter(F.col("variable").isin(list(needed))).select("variable").distinct().collect()}
    out = forcing.filter(F.col("variable").isin([v for v in wanted if v in have]))
    keys = [c for c in forcing.columns if c not in ("variable", "value")]
    for v in wanted:
        if v not in have:
            if not set(sums.get(v, [v])) <= have:
                raise ValueError(f"{v} is not in the source and cannot be summed from its {sorted(have)}")
            parts = forcing.filter(F.col("variable").isin(sums[v])).groupBy(*keys).agg(F.sum("value").alias("value")).withColumn("variable", F.lit(v))
            out = out.unionByName(parts)
    return out


def member(forcing: DataFrame, name: str) -> DataFrame:
    """One ensemble member, or ``all``."""
    if name == "all":
        return forcing
    own = forcing.filter(F.col("ensemble") == name)
    if own.isEmpty():
        raise ValueError(f"no ensemble member {name!r}")
    return own


def replicate(series: DataFrame, ensemble: DataFrame) -> DataFrame:
    """A single series for every member of another, whose ids are few."""
    ids = ensemble.select("ensemble").distinct()
    return series.drop("ensemble").crossJoin(F.broadcast(ids) if ids.count() <= 100_000 else ids)


def same_members(forcing: DataFrame) -> bool:
    """Whether every variable has the same ensemble members."""
    sets = forcing.groupBy("variable").agg(F.array_sort(F.collect_set("ensemble")).alias("e"))
    return sets.agg(F.countDistinct("e")).first()[0] <= 1


def ssp(raw: DataFrame, scenario: str) -> DataFrame:
    """One pathway of rows (scenario, variable, ensemble, year, value): whole years, and OHF from aerosol and other."""
    own = raw.filter(F.lower("scenario") == scenario.lower()).withColumn("t", F.floor("year").cast("int")).drop("year", "scenario")
    other = own.filter(F.col("variable").isin("aerosol", "other")).groupBy("ensemble", "t").agg(F.sum("value").alias("value")).withColumn("variable", F.lit("OHF"))
    names = {"ghg": "GHG", "natural": "Nat", "anthro": "Ant", "total": "Tot"}
    rename = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return own.filter(F.col("variable").isin(list(names))).withColumn("variable", rename[F.col("variable")]).unionByName(other)
