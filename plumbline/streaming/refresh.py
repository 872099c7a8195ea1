"""Growing regressions as a stream: new rows update the sums, and coefficients follow from the sums.

A regression needs only the count, the sums and the sums of products of each key, so a
stream keeps those and not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sums(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Works on a batch or a stream (output mode complete or update)."""
    a, b = F.col(x), F.col(y)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))


def slopes(of: DataFrame, keys: list[str]) -> DataFrame:
    """slope and level of each key; null where x does not vary."""
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(det != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    return of.select(*keys, slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("level"))


def windowed_means(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str = "value") -> DataFrame:
    """Means over tumbling windows, closed when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "mean", "n")
