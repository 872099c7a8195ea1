"""Reductions over an ensemble."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import observed

PERCENTILES = [5.0, 17.0, 83.0, 95.0, 50.0]


def percentiles(df: DataFrame, keys: list[str], value: str = "value", qs: list[float] = PERCENTILES) -> DataFrame:
    """keys, percentile, value: interpolated; NaN if any value is NaN, null if any is missing. For groups that a task can hold; else ``selection``."""
    exact = F.percentile(value, F.array(*(F.lit(q / 100) for q in qs)))
    agg = df.groupBy(*keys).agg(exact.alias("ps"), F.max(F.isnan(value)).alias("nan"), F.max(F.isnull(value)).alias("missing"))
    value_of = F.when(F.col("missing"), F.lit(None).cast("double")).when(F.col("nan"), F.lit(float("nan"))).otherwise(F.col("x.p"))
    each = agg.select(*keys, "nan", "missing", F.explode(F.arrays_zip(F.array(*(F.lit(q) for q in qs)).alias("q"), F.col("ps").alias("p"))).alias("x"))
    return each.select(*keys, F.col("x.q").alias("percentile"), value_of.alias("value"))


def weighted_mean(df: DataFrame, keys: list[str], repeats: int, value: str = "value", weight: str = "weight") -> DataFrame:
    """Mean over repeats weighted by their sizes; null where a repeat lacks the key."""
    agg = df.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count(value).alias("n"))
    return agg.select(*keys, F.when(F.col("n") == repeats, F.col("mean")).alias("value"))


def rms(value: str = "value") -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


#: Terms of a density's expansion in a cell of one bandwidth: what is left out is under 1e-11 of a value's own peak.
TERMS = 16


def _moments(u: Column) -> list[Column]:
    """Sums of u^n / n!, of values by their distance from the middle of their cell."""
    return [F.sum(F.pow(u, F.lit(n)) / math.factorial(n)).alias(f"m{n}") for n in range(TERMS)]


def _bells(t: Column) -> Column:
    """The sum over a cell's values of exp(-(t - u)^2), from the cell's moments, at a distance t from its middle: a series in Hermite functions."""
    moments = F.array(*(F.struct(F.lit(float(n)).alias("n"), F.col(f"m{n}").alias("m")) for n in range(TERMS)))
    first = F.exp(-t * t)
    start = F.struct(F.lit(0.0).alias("before"), first.alias("now"), F.lit(0.0).alias("total"))

    def term(acc, x):
        after = 2.0 * t * acc["now"] - 2.0 * x["n"] * acc["before"]
        return F.struct(acc["now"].alias("before"), after.alias("now"), (acc["total"] + x["m"] * acc["now"]).alias("total"))

    return F.aggregate(moments, start, term, lambda acc: acc["total"])


#: Values of a group up to which its density is summed over the values themselves.
FEW_VALUES = 1024


def _small_kde(df: DataFrame, keys: list[str], points: int, value: str, bounds: tuple[float, float] | None) -> DataFrame:
    """keys, i, x, density of groups of a row each: their values are an array."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    arrays = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(value).cast("double")).alias("_values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(points)
        for batch in batches:
            held, at = batch.column("_values"), batch.column("_values").offsets.to_numpy()
            values, rows, xs, found = held.values.to_numpy(), [], [], []
            for r in range(len(batch)):
                v = values[at[r] : at[r + 1]]
                if len(v) < 2 or np.ptp(v) == 0:
                    continue
                h = v.std(ddof=1) * len(v) ** -0.2
                lo, hi = bounds or (v.min(), v.max())
                x = lo + (hi - lo) * steps / (points - 1)
                rows.append(r)
                xs.append(x)
                found.append(np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi)))
            flat = lambda parts: pa.array(np.concatenate([np.zeros(0), *parts]))
            which = pa.array(np.repeat(np.array(rows, np.int64), points))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(which) for k in keys), pa.array(np.tile(steps, len(rows)).astype(np.int32)), flat(xs), flat(found)], [*keys, "i", "x", "density"])

    return arrays.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "i int, x double, density double"]))


def kde(df: DataFrame, keys: list[str], points: int, value: str = "value", bounds: tuple[float, float] | None = None) -> DataFrame:
    """Gaussian density with Scott's bandwidth on ``points`` grid points, from the least to the greatest value or over the bounds.

    Values are added up in cells of one bandwidth, as the moments of a series in Hermite functions, before anything is shuffled;
    grid points meet cells, not values. Groups of at most ``FEW_VALUES`` are summed directly, each in one row. Groups whose values are all equal have no density.
    """
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("least"), F.max(value).alias("most"))
    small = F.col("n") <= FEW_VALUES
    stats, seen = observed(stats.filter("s > 0").withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2))), small=F.count_if(small), large=F.count_if(~small))
    if not seen["large"]:
        return _small_kde(df, keys, points, value, bounds)
    rest, large = None, stats.filter(~small)
    if seen["small"]:
        own = stats.filter(small).select(*(F.col(k).alias(f"_{k}") for k in keys))
        rest = _small_kde(df.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi"), keys, points, value, bounds)
    lo, hi = (F.lit(float(b)) for b in bounds) if bounds else (F.col("least"), F.col("most"))
    named = large.select(*(F.col(k).alias(f"_{k}") for k in keys), "n", "h", "least", lo.alias("lo"), hi.alias("hi"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    cell = F.floor((F.col(value) - F.col("least")) / F.col("h"))
    u = (F.col(value) - F.col("least") - (F.col("cell") + 0.5) * F.col("h")) / (F.col("h") * math.sqrt(2))
    cells = df.filter(F.col(value).isNotNull()).join(named, same).withColumn("cell", cell).groupBy(*keys, "cell").agg(*_moments(u))
    grid = named.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    t = (F.col("x") - F.col("least") - (F.col("cell") + 0.5) * F.col("h")) / (F.col("h") * math.sqrt(2))
    each = cells.join(grid, same).withColumn("t", t).select(*keys, "i", "x", "n", "h", _bells(F.col("t")).alias("bells"))
    found = each.groupBy(*keys, "i", "x").agg((F.sum("bells") / F.first("n") / F.first("h") / math.sqrt(2 * math.pi)).alias("density"))
    return found if rest is None else found.unionByName(rest)


def sampled(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """min(n, available) rows without replacement, the same ones for a seed: those with the least md5."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
