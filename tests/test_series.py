"""Percentiles from the targets themselves are those from coefficients, and what is written grows with neither response members nor ranges."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution as at
from plumbline.operators import sumset
from plumbline.operators import timeseries as ts
from plumbline.plans import queries as plans
from plumbline.sources import standins, stored

from .test_linear import V, same
from .test_sumset import made


def packed(ctl, last):
    return ctl.filter(F.col("t").between(0, last)).groupBy(F.col("member").alias("target")).agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s")).select("target", F.col("s.value").alias("ys"))


@pytest.mark.parametrize("block", [8192, 3])
def test_as_from_coefficients(spark, monkeypatch, block):
    wide, obs, ctl, _, _ = made(spark)
    monkeypatch.setattr(at, "BLOCK", (block, block))
    monkeypatch.setattr(at, "LEAST_ROWS", 5)
    monkeypatch.setattr(sumset, "FEW", 2)
    both, coef = at.series(wide, obs, packed(ctl, 20), V, 0, 20), at.coefficients(wide, obs, ctl, V, 0, 20).persist()
    odd = wide.withColumn("GHG", F.when(F.col("t") == 3, None).when(F.col("t") == 4, float("nan")).otherwise(F.col("GHG")))
    for responses, const in ((wide, 1.0), (odd, 0.0)):
        same(sumset.percentiles(at.linear(responses, both, V, obs, const), ["t", "variable"]), sumset.percentiles(at.sums(responses, coef, V, obs, const), ["t", "variable"]), ["t", "variable"])


def test_growing_as_from_coefficients(spark):
    wide, obs, ctl, _, _ = made(spark)
    both, coef = at.series(wide, obs, packed(ctl, 20), V, 0, 20, 18), at.growing_coefficients(wide, obs, ctl, V, 0, 18, 20).persist()
    ends = coef.select("end_step").distinct()
    assert {r.end_step for r in ends.collect()} == {r.end_step for r in both.weights.select("end_step").collect()} == {17, 18, 19, 20}
    each, keys = wide.filter("t < 3").crossJoin(ends), ["end_step", "t", "variable"]
    same(sumset.percentiles(at.linear(each, both, V, on=["end_step"]), keys), sumset.percentiles(at.sums(each, coef, V, on=["end_step"]), keys), keys)


def test_targets_with_gaps_are_left_to_coefficients(spark):
    wide, obs, ctl, _, _ = made(spark)
    assert at.series(wide, obs.filter("not (member = 'o1' and t = 3)"), packed(ctl, 20), V, 0, 20) is None
    one = wide.first()
    lacking = wide.filter((F.col("model") != one.model) | (F.col("ensemble") != one.ensemble) | (F.col("t") != 3))
    assert at.series(lacking, obs, packed(ctl, 20), V, 0, 20) is None


def vectors(path, rows):
    os.makedirs(path, exist_ok=True)
    ids, values, labels = zip(*rows, strict=True)
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(values, pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}), f"{path}/embeddings.parquet")
    return str(path)


def test_slices_where_their_vectors_are(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=n) * 0.12).tolist(), i % 3) for i, n in enumerate([64] * 150 + [27, 26, 39, 40, 0, 90])]
    rows += [(900, None, 1), (901, [float("nan")] * 64, 1), (902, [0.0] * 64, None)]
    at_ = vectors(tmp_path / "a", rows)
    got = {r.target: r.ys for r in standins.control_series(spark, at_).collect()}
    want: dict = {}
    for r in standins.control_targets(spark, at_).collect():
        want.setdefault(r.member, {})[r.t] = r.value
    assert got.keys() == want.keys() and len(got) > 20
    assert all(np.allclose(got[k], [want[k][t] for t in range(27)], rtol=0, atol=1e-12) for k in got)
    assert standins.control_series(spark, vectors(tmp_path / "b", [*rows, (3, rows[0][1], 2)])) is None  # an id twice
    assert standins.control_series(spark, vectors(tmp_path / "c", [*rows, (999, [0.1, None] * 32, 2)])) is None
    assert "Exchange" not in standins.control_series(spark, at_)._jdf.queryExecution().executedPlan().toString()


def test_segments_of_arrays_of_any_length(spark):
    df = spark.createDataFrame([("a", [0.0, 0.1] * 6), ("b", [])], "member string, series array<double>")
    got = {(r.member, r.slice_start): r.ys for r in ts.kept_segments(df, 4, 2, (2, 0.3, -1.0), (3, 0.3)).collect()}
    assert sorted(got) == [("a", s) for s in range(0, 10, 2)] and np.allclose(got["a", 2], [-0.05, 0.05] * 2)


def written(before):
    return sum(os.path.getsize(os.path.join(r, f)) for p in stored._written[before:] for r, _, files in os.walk(p.removeprefix("file://")) for f in files)


def test_what_a_growing_run_writes(spark, sf, tmp_path, monkeypatch):
    """12 ranges and 14 response members of 900 slices write less than a coefficient for each of them."""
    rng = np.random.default_rng(4)
    for f in os.listdir(sf):
        if f != "embeddings.parquet":
            os.symlink(f"{sf}/{f}", tmp_path / f)
    at_ = vectors(tmp_path, [(i, (rng.normal(size=64) * 0.12).tolist(), i % 10) for i in range(1500)])
    monkeypatch.setattr(at, "LEAST_ROWS", 1)
    before = len(stored._written)
    assert plans.QUERIES["hist_only_annual"](spark, at_).count() == 12 * 5 * 5
    targets = standins.control_series(spark, at_).count()
    assert targets > 900 and written(before) < 12 * 14 * targets * 8
