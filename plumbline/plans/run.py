"""A whole attribution run, and the combination of repeated runs.

``run`` takes the series of a ``RunConfig`` (loaded from files by ``load``, or any frames of these columns) through sampling,
responses, regression and pairing to percentiles of the series, its headlines and rates, and
writes them to a table partitioned by the run's keys. ``combine`` reads the finished repeats of such a table and
averages them by their sizes; ``historical``, ``constrained``, ``revisions`` and ``full_information`` compare runs of growing ranges.
``run_matrix`` starts what a matrix of runs lacks. Ranges are inclusive; a range beyond the data is cut to it.
"""

from __future__ import annotations

import functools
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution as at
from ..operators import products, response, summary, sumset
from ..operators import timeseries as ts
from ..sources import files, scenarios
from ..sources.stored import observed, stored
from .config import RunConfig, clamp, headline_years

#: The years of a fitted trend (its end year and the 15 before it) and of a decade, and the years before and after that a centred mean takes.
TREND, DECADE, CENTRED = 16, 10, (9, 10)


@dataclass(frozen=True)
class Inputs:
    forcing: DataFrame  # variable, ensemble, t, value
    temperature: DataFrame  # member, t, value
    control: DataFrame  # member, t (from 0), value
    parameters: DataFrame  # model, box, d, q


def load(spark: SparkSession, root: str, config: RunConfig, layout: scenarios.Layout = scenarios.Layout()) -> Inputs:
    forcing = scenarios.load_forcing(spark, root, config.scenario, list(config.variables), config.ensemble_member, layout)
    temperature = scenarios.load_temperature(spark, root, config.scenario, config.preindustrial, config.ensemble_member, layout)
    rows = temperature.select("t").distinct().count()
    # A control slice has no dates: its baseline is one row shorter than the era, whose last year counts in measurements and responses alone.
    era = config.preindustrial[1] - config.preindustrial[0]
    return Inputs(forcing, temperature, scenarios.load_control(spark, root, rows, era, layout=layout), files.read_parameters(spark, f"{root}/{layout.parameters}"))


def _sampled(df: DataFrame, key: str, config: RunConfig, seed: str) -> tuple[DataFrame, int]:
    """The members that a run of ``samples`` takes, all where there are no more, and their number."""
    chosen, seen = observed(summary.sampled(df.select(key).distinct(), key, config.samples, seed), n=F.count("*"))
    return df.join(F.broadcast(chosen), key, "left_semi"), seen["n"]


def attribute(inputs: Inputs, config: RunConfig, seed: str = "") -> tuple[dict[str, DataFrame], int]:
    """Frames (label, variable, percentile, value) timeseries, headlines and rates, and the size of the ensemble."""
    variables = sorted(config.variables)
    span = {"first": F.min("t"), "last": F.max("t")}
    (forcing, n_forcing), (obs, n_obs), (ctl, n_ctl) = _sampled(inputs.forcing, "ensemble", config, seed + "f"), _sampled(inputs.temperature, "member", config, seed + "o"), _sampled(inputs.control, "member", config, seed + "c")
    (forcing, have), (obs, measured) = observed(forcing, **span), observed(obs, **span)
    have, measured = (have["first"], have["last"]), (measured["first"], measured["last"])
    regress, shown = clamp(config.regress, measured, have), clamp(config.output_range, have)
    # Control noise has no dates: its first row is the first year that is shown.
    ctl = stored(ctl.withColumn("t", (F.col("t") + shown[0]).cast("long")))
    raw = response.box_response(forcing, inputs.parameters)
    resp = ts.baseline_mean(raw, ["model", "ensemble", "variable"], *config.preindustrial)
    wide = stored(at.wide(resp, variables))
    coef = at.sides(stored(at.coefficients(wide, obs, ctl, variables, *regress)), variables)
    if not coef.buckets:
        coef = replace(coef, obs=stored(coef.obs), ctl=stored(coef.ctl))  # each part of the results joins them
    out, n_out = coef.laid(wide.filter(F.col("t").between(*shown)))
    qs = list(config.percentiles)

    def reduced(of, years: list[int], const: float = 1.0) -> DataFrame:
        """The sides of a linear functional of the series, taken before the pairing, at the years."""
        per = of(at.long(out, variables, ["model", "ensemble", "t"]), ["model", "ensemble", "variable"]).filter(F.col("t").isin(years)).select("model", "ensemble", "variable", "t", "value")
        per, n = coef.laid(at.wide(per, variables))
        return at.sums(per, coef, variables, const=const, rows=n)

    full = lambda before, after: lambda df, keys: ts.rolling_mean(df, keys, before, after, "mean").filter("mean is not null").withColumn("value", F.col("mean"))
    ways = {
        "ANNUAL": lambda df, keys: df, "SR15": lambda df, keys: ts.trend(df, keys, TREND).withColumn("value", F.col("end")),
        "AR6": full(DECADE - 1, 0), "CGWL": full(*CENTRED),
    }
    parts = {"timeseries": at.sums(out, coef, variables, obs, rows=n_out)}
    parts |= {d: reduced(ways[d], headline_years(config.headline_years, regress[1], shown[1], d)) for d in config.headlines}
    if config.include_rate:
        slopes = lambda df, keys: ts.trend(df, keys, DECADE).withColumn("value", F.col("slope"))
        parts["RATE"] = reduced(slopes, list(range(max(config.first_rate, shown[0] + DECADE - 1), shown[1] + 1)), const=0.0)
    # All that is reported is selected at once.
    each = [rows.select(F.lit(kind).alias("kind"), "t", "variable", "a", "c") for kind, rows in parts.items()]
    values = stored(sumset.percentiles(functools.reduce(DataFrame.unionByName, each), ["kind", "t", "variable"], qs))
    named = values.select("kind", functools.reduce(lambda c, k: c.when(F.col("kind") == k, products.label(k, F.col("t"))), [k for k in parts if k != "timeseries"], F.when(F.col("kind") == "timeseries", F.col("t").cast("string"))).alias("label"), "variable", "percentile", "value")
    of = lambda kinds: named.filter(F.col("kind").isin(kinds)).drop("kind")
    found = {"timeseries": of(["timeseries"]), "headlines": of(list(config.headlines))}
    if config.include_rate:
        found["rates"] = of(["RATE"])
    return found, n_forcing * inputs.parameters.select("model").distinct().count() * n_obs * n_ctl


def run_key(config: RunConfig) -> dict[str, str]:
    return {"scenario": config.scenario, "ensemble_member": config.ensemble_member, "variables": "-".join(sorted(config.variables)), "regressed_years": "{}-{}".format(*config.regress)}


def run(spark: SparkSession, config: RunConfig, inputs: Inputs, out: str, repeat: int = 0) -> int:
    """Writes one repeat's results to ``out``/result_type, marks it as finished and returns the size of its ensemble.

    The mark comes last and names what this run wrote, so a run that ends before it leaves nothing that is read.
    """
    found, size = attribute(inputs, config, f"{repeat}/")
    keys, own = {**run_key(config), "samples": str(config.samples), "repeat": str(repeat)}, uuid.uuid4().hex
    for kind, rows in found.items():
        named = rows.withColumns({**{k: F.lit(v) for k, v in keys.items()}, "size": F.lit(size).cast("long"), "run_id": F.lit(own)})
        files.write_results(named, f"{out}/{kind}", list(keys))
    files.mark_finished(spark, out, keys, own)
    return size


def finished_results(spark: SparkSession, results: str, kind: str) -> DataFrame:
    """The rows of a result type that finished runs wrote."""
    done = files.finished(spark, results).select("run_id").distinct()
    return spark.read.parquet(f"{results}/{kind}").join(done, "run_id", "left_semi")


def combine(spark: SparkSession, results: str, kind: str = "timeseries") -> DataFrame:
    """The run keys, label, variable, percentile, value: means of all finished repeats of each run, weighted by their sizes; null where a repeat lacks the label."""
    rows = finished_results(spark, results, kind)
    keys = files.RESULT_KEYS
    repeats = rows.groupBy(*keys).agg(F.countDistinct("run_id").alias("repeats"))
    mean = rows.groupBy(*keys, "label", "variable", "percentile").agg((F.sum(F.col("value") * F.col("size")) / F.sum("size")).alias("mean"), F.count("value").alias("n"))
    return mean.join(repeats, keys).select(*keys, "label", "variable", "percentile", F.when(F.col("n") == F.col("repeats"), F.col("mean")).alias("value"))


#: What tells sets of runs apart that differ in their regressed years alone.
SET = ["scenario", "ensemble_member", "variables"]


def _ends(rows: DataFrame) -> DataFrame:
    return rows.withColumn("end_step", F.element_at(F.split("regressed_years", "-"), -1).cast("int")).drop("regressed_years")


def historical(spark: SparkSession, results: str, definition: str) -> DataFrame:
    """The set's keys, end_step, label, variable, percentile, value: of every finished run, its own headline for the last year that it regresses."""
    rows = combine(spark, results, "timeseries" if definition == "ANNUAL" else "headlines")
    return products.historical_only(_ends(rows), definition, SET)


def _years(spark: SparkSession, results: str) -> DataFrame:
    return _ends(combine(spark, results)).withColumn("t", F.col("label").cast("int")).drop("label")


def constrained(spark: SparkSession, results: str) -> DataFrame:
    """The set's keys, end_step, variable, percentile, value: what each run says of the last year that any run regresses."""
    return products.constrained(_years(spark, results), SET)


def revisions(spark: SparkSession, results: str) -> tuple[DataFrame, DataFrame]:
    """What each run's last year added, and how it revised the year before."""
    return products.deltas(_years(spark, results), SET)


def full_information(spark: SparkSession, results: str, temperature: DataFrame, variables: tuple[str, ...] = ("Tot", "Ant", "Nat")) -> DataFrame:
    """All definitions' means of the median of the longest run of each set, and what they differ by from the measured 20-year mean."""
    years = _years(spark, results).filter((F.col("percentile") == 50) & F.col("variable").isin(list(variables)))
    last = years.groupBy(*SET).agg(F.max("end_step").alias("end_step"))
    measured = temperature.groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    return products.full_information(years.join(F.broadcast(last), [*SET, "end_step"]), measured, by=SET)


def run_matrix(spark: SparkSession, configs: list[RunConfig], repeats: int, out: str, loaded) -> list[tuple[RunConfig, int]]:
    """Runs every config that often, but for what a finished run has already written; the list of what was run. ``loaded`` gives the inputs of a config.

    A second start after a loss does the rest only.
    """
    wanted = [({**run_key(c), "samples": str(c.samples), "repeat": str(k)}, i, k) for i, c in enumerate(configs) for k in range(repeats)]
    names = list(wanted[0][0]) if wanted else []
    plan = spark.createDataFrame([(*keys.values(), i, k) for keys, i, k in wanted], ", ".join([*(f"{n} string" for n in names), "config int", "k int"])) if wanted else None
    lacking = [] if plan is None else plan.join(files.finished(spark, out), names, "left_anti").orderBy("config", "k").collect()
    for r in lacking:
        run(spark, configs[r.config], loaded(configs[r.config]), out, r.k)
    return [(configs[r.config], r.k) for r in lacking]


def export(combined: DataFrame, path: str, variables: tuple[str, ...] = ("Nat", "Ant", "Tot")) -> None:
    """One wide CSV of the named variables of one run."""
    files.write_result_csv(combined.filter(F.col("variable").isin(list(variables)) & F.col("value").isNotNull()).select("label", "variable", "percentile", "value"), path)
