"""Exact percentiles by selection: passes over the rows instead of a buffer of them.

The rows of a group can be the product of whole ensembles, more than a task or a shuffle should
hold. The first pass finds each group's bounds, the second counts its values in equal bins (added up
before the shuffle), and the third takes only the values in bins that hold a wanted rank, counted by value. What is
shuffled is groups x bins numbers a task, and some values of each group. Rows are made anew in each pass, from
inputs that should be cheap to read (stored).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .summary import PERCENTILES

BINS = 1024


def percentiles(df: DataFrame, keys: list[str], value: str = "value", qs: list[float] = PERCENTILES, bins: int = BINS) -> DataFrame:
    """keys, percentile, value: interpolated; NaN if any value is NaN, null if any is missing. As ``summary.percentiles``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    # NaN orders last, so the greatest value tells whether there is one; null keys are groups too.
    bounds = stored(rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.count("v").alias("present")))
    odd = (F.col("present") < F.col("n")) | F.isnan("hi")
    sound = bounds.filter(~odd).select(*(F.col(k).alias(f"_{k}") for k in keys), "lo", "hi", "n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    bin_of = F.when(F.col("hi") > F.col("lo"), place).otherwise(0).cast("int")
    placed = rows.join(sound, same).select(*keys, "v", "n", bin_of.alias("bin"))
    up_to = Window.partitionBy(*keys).orderBy("bin")
    counted = placed.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("upto", F.sum("c").over(up_to))
    # The two ranks around each percentile, from 0, and the percentile's place between them.
    at = [(q, (F.col("n") - 1) * (q / 100)) for q in qs]
    ranks = F.array(*(F.struct(F.lit(float(q)).alias("q"), F.floor(p).alias("low"), F.ceil(p).alias("high"), (p - F.floor(p)).alias("part")) for q, p in at))
    inside = lambda rank: (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
    wanted = F.filter(ranks, lambda r: inside(r["low"]) | inside(r["high"]))
    hit = stored(counted.select(*keys, "bin", (F.col("upto") - F.col("c")).alias("before"), wanted.alias("ranks")).filter(F.size("ranks") > 0))
    named = hit.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("bin").alias("_bin"), "before", "ranks")
    values = placed.join(named, [*same, F.col("bin") == F.col("_bin")]).groupBy(*keys, "bin", "v").agg(F.count("*").alias("c"), F.first("before").alias("before"), F.first("ranks").alias("ranks"))
    in_bin = Window.partitionBy(*keys, "bin").orderBy("v")
    ordered = values.withColumn("upto", F.col("before") + F.sum("c").over(in_bin)).select(*keys, "v", "c", "upto", F.explode("ranks").alias("r"))
    is_low, is_high = inside(F.col("r.low")), inside(F.col("r.high"))
    ends = ordered.filter(is_low | is_high).groupBy(*keys, F.col("r.q").alias("percentile")).agg(F.max(F.when(is_low, F.col("v"))).alias("low"), F.max(F.when(is_high, F.col("v"))).alias("high"), F.first("r.part").alias("part"))
    found = ends.select(*keys, "percentile", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))
    nothing = F.when(F.col("present") < F.col("n"), F.lit(None).cast("double")).otherwise(F.lit(float("nan")))
    return found.union(bounds.filter(odd).select(*keys, F.explode(F.array(*(F.lit(float(q)) for q in qs))).alias("percentile"), nothing.alias("value")))
