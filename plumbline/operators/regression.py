"""Least squares with a constant: in closed form on covariances, or by orthogonal factors of blocks of rows."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import observed, stored


def _det(m: list[list]):
    if len(m) == 1:
        return m[0][0]
    return sum(((1 if j % 2 == 0 else -1) * m[0][j] * _det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(1, len(m))), m[0][0] * _det([row[1:] for row in m[1:]]))


#: Least determinant of the regressors' correlations that the closed form is trusted with.
LEAST_DET = 1e-10


def _solved(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """keys, b_<x>, b_const, sound: whether the regressors are far enough from dependent."""
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    agg = df.groupBy(*keys).agg(*(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs), *(F.covar_pop(a, y).alias(f"c_{a}_y") for a in xs), *(F.avg(c).alias(f"m_{c}") for c in xs), F.avg(y).alias("m_y"))
    c = lambda a, b: F.col(f"c_{a}_{b}" if (a, b) in pairs else f"c_{b}_{a}")
    m = [[c(a, b) for b in xs] for a in xs]
    det = _det(m)
    beta = [_det([[F.col(f"c_{a}_y") if k == j else m[i][k] for k in range(len(xs))] for i, a in enumerate(xs)]) for j in range(len(xs))]
    spread = math.prod((c(a, a) for a in xs), start=F.lit(1.0))
    sound = F.coalesce((spread > 0) & (det > LEAST_DET * spread), F.lit(False))
    solved = agg.withColumns({"sound": sound, **{f"b_{x}": F.when(sound, b / det) for x, b in zip(xs, beta, strict=True)}})
    const = F.col("m_y") - sum((F.col(f"b_{x}") * F.col(f"m_{x}") for x in xs), F.lit(0.0))
    return solved.select(*keys, *(f"b_{x}" for x in xs), const.alias("b_const"), "sound")


def ols(df: DataFrame, keys: list[str], xs: list[str], y: str = "y") -> DataFrame:
    """Per key: b_<x> for each regressor and b_const; null where the regressors are dependent, or nearly.

    One aggregation of covariances (map-side combined), then Cramer's rule on 1 to 3 regressors.
    """
    return _solved(df, keys, xs, y).drop("sound")


def fit(df: DataFrame, keys: list[str], xs: list[str], y: str = "y") -> DataFrame:
    """``ols``, and the minimum-norm solution for the keys whose regressors are dependent."""
    solved, seen = observed(_solved(df, keys, xs, y), rest=F.count_if(~F.col("sound")))
    rest = solved.filter(~F.col("sound")).select(*keys)
    good = solved.filter("sound").drop("sound")
    return good if not seen["rest"] else good.unionByName(lstsq(df.join(rest, keys, "left_semi"), keys, xs, y))


#: Factors that a task merges at once.
MERGED = 4096
_FACTOR = "_rows long, _factor array<double>"


def _typed(df: DataFrame, keys: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{k}` {kinds[k]}, " for k in keys)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> Iterator[np.ndarray]:
    """The places of each key's rows."""
    ids = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        ids = np.unique(ids * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(ids, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(ids[order])) + 1))


def _triangular(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def factors(df: DataFrame, keys: list[str], columns: list[str], merged: int = MERGED) -> DataFrame:
    """keys, _rows, _factor: the triangular factors (by rows) that stand for each key's rows of the columns, ``merged`` at most for a key.

    Each batch of a task is factored where it is, and stacked factors are factored again, in as many rounds of ``merged`` as a key needs.
    So a key may hold all rows, and conditions are not squared. Rows that lack a finite number count for nothing.
    """
    finite = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in columns]
    rows = df.select(*keys, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns))).filter(functools.reduce(operator.and_, finite))
    schema, width = _typed(df, keys) + _FACTOR, len(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.column_stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False) for i in range(width)])
            own = list(_runs(batch, keys))
            first = batch.take(pa.array([at[0] for at in own]))
            found = [_triangular(values[at]).ravel() for at in own]
            yield pa.RecordBatch.from_arrays([*(first.column(k) for k in keys), pa.array([len(at) for at in own], pa.int64()), pa.array(found, pa.list_(pa.float64()))], [*keys, "_rows", "_factor"])

    def merge(group: pa.Table) -> pa.Table:
        stack = _stacked(group, width)
        return group.slice(0, 1).select(keys).append_column("_rows", [[sum(group.column("_rows").to_pylist())]]).append_column("_factor", pa.array([_triangular(stack).ravel()], pa.list_(pa.float64())))

    parts, seen = observed(rows.mapInArrow(each, schema), n=F.count("*"))
    while seen["n"] > merged:
        most = parts.groupBy(*keys).count().agg(F.max("count")).first()[0]
        if most <= merged:
            break
        # By place, not by content: blocks of repeated rows have one factor.
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-most // merged)))
        parts, seen = observed(parts.withColumn("_part", part).groupBy(*keys, "_part").applyInArrow(merge, schema), n=F.count("*"))
    return parts


def _stacked(group: pa.Table, width: int) -> np.ndarray:
    return np.concatenate([x.flatten().to_numpy() for x in group.column("_factor").chunks]).reshape(-1, width)


def lstsq(df: DataFrame, keys: list[str], xs: list[str], y: str = "y", merged: int = MERGED) -> DataFrame:
    """The same by minimum-norm least squares on orthogonal factors, for dependent or ill-conditioned regressors and keys of any number of rows.

    Rows that lack a finite number are left out, and so are keys without any other row.
    """
    width = len(xs) + 2
    named = df.select(*keys, *(F.col(x) for x in xs), F.lit(1.0).alias("_const"), F.col(y).alias("_y"))

    def solve(group: pa.Table) -> pa.Table:
        stack, n = _stacked(group, width), sum(group.column("_rows").to_pylist())
        b = np.linalg.lstsq(stack[:, :-1], stack[:, -1], rcond=np.finfo(float).eps * max(n, width - 1))[0]
        out = group.slice(0, 1).select(keys)
        for name, v in zip([*(f"b_{x}" for x in xs), "b_const"], b.tolist(), strict=True):
            out = out.append_column(name, [[v]])
        return out

    schema = _typed(df, keys) + ", ".join([*(f"`b_{x}` double" for x in xs), "b_const double"])
    return factors(named, keys, [*xs, "_const", "_y"], merged).groupBy(*keys).applyInArrow(solve, schema)


def weights(df: DataFrame, keys: list[str], xs: list[str]) -> DataFrame:
    """keys, t, w_<x>, w_const: what each step's y counts for in each coefficient, from rows of the regressors alone.

    The rows of the pseudo-inverse, so sums of w * y are the minimum-norm least squares of any y that has all steps; a group is one series.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [*(f"w_{x}" for x in xs), "w_const"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, "t"]), *(f"{w} double" for w in out)])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        design = np.column_stack([group[xs].to_numpy(float), np.ones(len(group))])
        w = np.linalg.pinv(design, rcond=np.finfo(float).eps * max(design.shape)).T
        return pd.concat([group[[*keys, "t"]].reset_index(drop=True), pd.DataFrame(w, columns=out)], axis=1)

    return df.select(*keys, "t", *xs).groupBy(*keys).applyInPandas(solve, schema)


def growing_weights(df: DataFrame, keys: list[str], xs: list[str], least: int) -> DataFrame:
    """keys, start (weights of the first ``least`` steps for each coefficient), steps (t, x_<x>, k_<coefficient>): recursive least squares of any y.

    A step moves the coefficients by k times what the step's y differs from them; k comes from rank-one updates of the inverse of the
    cross-moments. Regressors that are dependent, or nearly, over the first steps get no rows; a group is one series.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*xs, "const"]
    step = f"struct<t: {kinds['t']}, {', '.join([*(f'x_{x}: double' for x in xs), *(f'k_{c}: double' for c in names)])}>"
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"start struct<{', '.join(f'{c}: array<double>' for c in names)}>", f"steps array<{step}>"])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t")
        # Orthonormal columns of the first steps: their cross-moments are the unit matrix, so updates start from no error.
        design = np.column_stack([group[xs].to_numpy(float), np.ones(len(group))])
        q, r = np.linalg.qr(design[:least])
        if len(group) < least or np.linalg.cond(r) > 1 / (np.finfo(float).eps * least):
            return pd.DataFrame(columns=[*keys, "start", "steps"])
        back = np.linalg.inv(r)
        turned, inverse, gains = design @ back, np.eye(len(names)), np.zeros(design.shape)
        for i in range(least, len(design)):
            x = turned[i]
            toward = inverse @ x
            gains[i] = toward / (1 + x @ toward)
            inverse -= np.outer(gains[i], toward)
        own = gains @ back.T
        start = dict(zip(names, (back @ q.T).tolist(), strict=True))
        steps = [{"t": t, **{f"x_{x}": v for x, v in zip(xs, row, strict=False)}, **{f"k_{c}": g for c, g in zip(names, k, strict=True)}} for t, row, k in zip(group["t"], design.tolist(), own.tolist(), strict=True)]
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), start, steps]], columns=[*keys, "start", "steps"])

    return df.select(*keys, "t", *xs).groupBy(*keys).applyInPandas(solve, schema)


def range_weights(df: DataFrame, keys: list[str], xs: list[str], least: int) -> DataFrame:
    """keys, end_step, w_<x>, w_const (arrays by step): what each step's y counts for in each coefficient of every range of ``least`` steps and more.

    ``growing_weights`` of a y that is one at a step and zero elsewhere, for each of the steps; those after a range count for zero.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*xs, "const"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"end_step {kinds['t']}", *(f"w_{c} array<double>" for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                steps = r["steps"]
                w = np.zeros((len(names), len(steps)))
                w[:, :least] = [r["start"][c] for c in names]
                for i in range(least - 1, len(steps)):
                    if i >= least:
                        seen = np.zeros(len(steps))
                        seen[i] = 1.0
                        seen -= np.array([*(steps[i][f"x_{x}"] for x in xs), 1.0]) @ w
                        w = w + np.outer([steps[i][f"k_{c}"] for c in names], seen)
                    rows.append({**{k: r[k] for k in keys}, "end_step": steps[i]["t"], **{f"w_{c}": v for c, v in zip(names, w.tolist(), strict=True)}})
            types = [*(batch.schema.field(k).type for k in keys), batch.schema.field("steps").type.value_type.field("t").type, *[pa.list_(pa.float64())] * len(names)]
            columns = [*keys, "end_step", *(f"w_{c}" for c in names)]
            yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in rows], t) for c, t in zip(columns, types, strict=True)], columns)

    return growing_weights(df, keys, xs, least).mapInArrow(run, schema)


def growing_ols(df: DataFrame, keys: list[str], x: str, y: str, least: int) -> DataFrame:
    """One regressor over all growing ranges in a single window pass: end, b_x, b_const for each end step with ``least`` rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    slope, level = F.regr_slope(y, x).over(w), F.regr_intercept(y, x).over(w)
    return df.withColumns({"n": F.count("*").over(w), "b_x": slope, "b_const": level}).filter(F.col("n") >= least).select(*keys, F.col("t").alias("end"), "b_x", "b_const")
