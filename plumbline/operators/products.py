"""Series derived from several runs: rows (end_step, label or t, variable, percentile, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import timeseries as ts


def label(definition: str, end):
    """The period label of a headline definition for an end step."""
    text = lambda c: c.cast("string")
    return {
        "ANNUAL": text(end), "AR6": F.concat_ws("-", text(end - 9), text(end)), "SR15": F.concat(text(end), F.lit(" (SR15 definition)")),
        "CGWL": F.concat(text(end - 9), F.lit("-"), text(end + 10), F.lit(" (CGWL definition)")), "RATE": F.concat(text(end - 9), F.lit("-"), text(end), F.lit(" (AR6 rate definition)")),
    }[definition]


def historical_only(runs: DataFrame, definition: str, by: list[str] | None = None) -> DataFrame:
    """For each run, its own label for its last step; labels whose values are all zero go. ``by``: further keys of runs."""
    own = runs.filter(F.col("label") == label(definition, F.col("end_step")))
    keys = [*(by or []), "end_step"]
    zero = own.groupBy(*keys).agg(F.max(F.col("value") != 0).alias("any")).filter(~F.col("any"))
    return own.join(zero, keys, "left_anti")


def constrained(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For every run, its value in the last step at which any run ends; runs reach beyond their own fit. ``by``: further keys of runs."""
    last = runs.groupBy(*(by or [])).agg(F.max("end_step").alias("t"))
    return runs.join(F.broadcast(last), [*(by or []), "t"]).drop("t")


def deltas(runs: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """delta_new: change over a run's last step; delta_rev: revision of the step before by the newer run. ``by``: further keys of runs."""
    keys = [*(by or []), "variable", "percentile"]
    runs = runs.filter(F.col("t") <= F.col("end_step"))
    at = lambda lag: runs.filter(F.col("t") == F.col("end_step") - lag).drop("t")
    before = at(1).withColumnRenamed("value", "before")
    new = at(0).join(before, [*keys, "end_step"]).select(*(by or []), "end_step", "variable", "percentile", (F.col("value") - F.col("before")).alias("value"))
    older = at(0).select(*keys, (F.col("end_step") + 1).alias("end_step"), F.col("value").alias("older"))
    revised = before.join(older, [*keys, "end_step"]).select(*(by or []), "end_step", "variable", "percentile", (F.col("before") - F.col("older")).alias("value"))
    return new, revised


#: Steps before and after that each definition's mean takes, of one run over all the data.
FULL_INFORMATION = {"ANNUAL": (0, 0), "AR6": (9, 0), "SR15": (15, 14), "CGWL": (10, 9)}


def full_information(series: DataFrame, measured: DataFrame, widths: dict[str, tuple[int, int]] = FULL_INFORMATION, by: list[str] | None = None) -> DataFrame:
    """definition, variable, t, value, less_measured: rolling means of (variable, t, value), and what they differ by from the centred 20-step mean of measured (t, value); null where a window is not full."""
    each, keys = None, [*(by or []), "variable"]
    for name, (before, after) in widths.items():
        one = ts.rolling_mean(series.select(*keys, "t", "value"), keys, before, after, "mean").select(F.lit(name).alias("definition"), *keys, "t", F.col("mean").alias("value"))
        each = one if each is None else each.unionByName(one)
    base = ts.centred_mean(measured.select(F.lit(0).alias("series"), "t", "value"), ["series"], 20, "base").select("t", "base")
    return each.join(base, "t", "left").select("definition", *keys, "t", "value", (F.col("value") - F.col("base")).alias("less_measured"))


def parted(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Adds part: the rows of the regressed steps, and those beyond; the last regressed step is in both, so that lines meet."""
    own = rows.filter(F.col("t").between(first, last)).withColumn("part", F.lit("regressed"))
    return own.unionByName(rows.filter(F.col("t") >= last).withColumn("part", F.lit("beyond")))
