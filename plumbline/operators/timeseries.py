"""Windows over equally spaced series: one row for each key and step ``t``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], before: int, after: int):
    return Window.partitionBy(*keys).orderBy("t").rowsBetween(-before, after)


def rolling_mean(df: DataFrame, keys: list[str], before: int, after: int, out: str, value: str = "value") -> DataFrame:
    """Mean over rows [-before, +after]; null where the frame is not full."""
    w = _over(keys, before, after)
    return df.withColumn(out, F.when(F.count(value).over(w) == before + after + 1, F.avg(value).over(w)))


def moving_average(df: DataFrame, keys: list[str], width: int, out: str = "ma", value: str = "value") -> DataFrame:
    """The full windows of ``width`` rows only, each at its last row."""
    return rolling_mean(df, keys, width - 1, 0, out, value).filter(F.col(out).isNotNull())


def centred_mean(df: DataFrame, keys: list[str], width: int, out: str) -> DataFrame:
    """Centred window; an even width has its extra row before the centre."""
    return rolling_mean(df, keys, width // 2, width - 1 - width // 2, out)


def step_change(df: DataFrame, keys: list[str], out: str = "delta", value: str = "value") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("t")))


def is_contiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """ok: whether the distinct steps of each key go up by one."""
    steps = df.select(*keys, "t").distinct().withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")))
    return steps.groupBy(*keys).agg(F.every(F.coalesce(F.col("d") == 1, F.lit(True))).alias("ok"))


def baseline_mean(df: DataFrame, keys: list[str], first: int, last: int, out: str = "value", value: str = "value") -> DataFrame:
    """Subtracts each series' mean over the steps first..last."""
    mean = F.avg(F.when(F.col("t").between(first, last), F.col(value))).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.col(value) - mean)


def baseline_median(df: DataFrame, first: int, last: int) -> DataFrame:
    """Subtracts one offset from all members: the mean over first..last of the members' median."""
    median = df.filter(F.col("t").between(first, last)).groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("m"))
    offset = median.agg(F.avg("m").alias("offset"))
    return df.crossJoin(F.broadcast(offset)).withColumn("value", F.col("value") - F.col("offset")).drop("offset")


def segments(df: DataFrame, keys: list[str], n: int, baseline_rows: int | None = None) -> DataFrame:
    """Half-overlapping slices of ``n`` rows: adds slice_start, and makes t the row within the slice."""
    h = n // 2
    row = F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1
    size = F.count("*").over(Window.partitionBy(*keys))
    placed = df.withColumns({"row": row, "slices": F.floor((size - (n - h)) / h)})
    lowest, highest = F.greatest(F.lit(0), F.ceil((F.col("row") - (n - 1)) / h)), F.least(F.col("slices") - 1, F.floor(F.col("row") / h))
    cut = placed.filter(lowest <= highest).withColumn("s", F.explode(F.sequence(lowest, highest)))
    cut = cut.withColumns({"slice_start": (F.col("s") * h).cast("long"), "t": (F.col("row") - F.col("s") * h).cast("long")}).drop("row", "slices", "s")
    return cut if baseline_rows is None else baseline_mean(cut, [*keys, "slice_start"], 0, baseline_rows - 1)


def in_range(df: DataFrame, keys: list[str], short: tuple[int, float, float], long: tuple[int, float]) -> DataFrame:
    """Keys of the series whose short moving mean stays strictly within +-limit with a spread over the least one, and whose long one within its limit."""
    (w, limit, spread), (w2, limit2) = short, long
    both = rolling_mean(rolling_mean(df, keys, w - 1, 0, "a"), keys, w2 - 1, 0, "b")
    agg = both.groupBy(*keys).agg(F.max("a").alias("a_max"), F.min("a").alias("a_min"), F.max("b").alias("b_max"), F.min("b").alias("b_min"))
    return agg.filter((F.col("a_max") < limit) & (F.col("a_min") > -limit) & (F.col("a_max") - F.col("a_min") > spread) & (F.col("b_max") < limit2) & (F.col("b_min") > -limit2)).select(*keys)


def _row_mean(rows: np.ndarray) -> np.ndarray:
    """Means of each row, added up from its first number on."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        total = total + rows[:, i]
    return total / rows.shape[1]


def kept_segments(df: DataFrame, n: int, baseline_rows: int, short: tuple[int, float, float], long: tuple[int, float]) -> DataFrame:
    """member, slice_start, ys: the ``segments`` that are ``in_range``, of whole series (member, series: array of doubles without a null), each where its row is."""
    (w, limit, spread), (w2, limit2) = short, long
    h = n // 2

    def means(y: np.ndarray, width: int) -> np.ndarray:
        return np.stack([_row_mean(y[:, i : i + width]) for i in range(n - width + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series = batch.column("series")
            sizes = np.diff(series.offsets.to_numpy())
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                values = series.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), size)
                for start in range(0, max(0, (int(size) - (n - h)) // h) * h, h):
                    y = values[:, start : start + n]
                    with np.errstate(invalid="ignore"):
                        y = y - _row_mean(y[:, :baseline_rows])[:, None]
                        a, b = means(y, w), means(y, w2)
                        # NaN is in no range.
                        own = np.flatnonzero((a.max(axis=0) < limit) & (a.min(axis=0) > -limit) & (a.max(axis=0) - a.min(axis=0) > spread) & (b.max(axis=0) < limit2) & (b.min(axis=0) > -limit2))
                    ys = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(y[own]).ravel()))
                    yield pa.RecordBatch.from_arrays([batch.column("member").take(pa.array(of[own])), pa.array(np.full(len(own), start), pa.int64()), ys], ["member", "slice_start", "ys"])

    kind = df.schema["member"].dataType.simpleString()
    return df.select("member", "series").mapInArrow(run, f"member {kind}, slice_start long, ys array<double>")


def trend(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """slope, end (the fitted value at the last row) over the trailing ``width`` rows; full windows only."""
    w = _over(keys, width - 1, 0)
    slope, level = F.regr_slope("value", "t").over(w), F.regr_intercept("value", "t").over(w)
    return df.withColumns({"rows": F.count("value").over(w), "slope": slope, "end": level + slope * F.col("t")}).filter(F.col("rows") == width).drop("rows")


def signal(df: DataFrame, keys: list[str], width: int, method: str = "extrapolate", end_value: float = 1.5) -> DataFrame:
    """Moving mean as long as the series: zeros before it; after it ``end_value``, or the least-squares line of its last rows."""
    bounds = df.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    before, after = width // 2, width - 1 - width // 2
    pads = []
    if before:
        pads.append(bounds.select(*keys, F.explode(F.sequence(F.col("lo") - before, F.col("lo") - 1)).alias("t"), F.lit(0.0).alias("value")))
    if after:
        steps = bounds.select(*keys, "hi", F.explode(F.sequence(F.col("hi") + 1, F.col("hi") + after)).alias("t"))
        if method == "constant":
            pads.append(steps.select(*keys, "t", F.lit(end_value).alias("value")))
        else:
            line = df.join(bounds, keys).filter(F.col("t") > F.col("hi") - width).groupBy(*keys).agg(F.regr_slope("value", "t").alias("b"), F.regr_intercept("value", "t").alias("a"))
            pads.append(steps.join(line, keys).select(*keys, "t", (F.col("a") + F.col("b") * F.col("t")).alias("value")))
    whole = df.select(*keys, "t", "value")
    for p in pads:
        whole = whole.unionByName(p.select(*keys, F.col("t").cast(df.schema["t"].dataType).alias("t"), "value"))
    return rolling_mean(whole, keys, before, after, "signal").filter(F.col("signal").isNotNull()).select(*keys, "t", "signal")


def last_value(value: Column | str = "value") -> Column:
    return F.max_by(value, "t")
