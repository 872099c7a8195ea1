"""Sums that are linear in coefficients give what their arrays give, and the arrays are never written."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution as at
from plumbline.operators import sumset
from plumbline.sources import stored

from .test_sumset import made

V = ["GHG", "Nat", "OHF"]


def same(got, want, keys):
    of = lambda df: {(*(r[k] for k in keys), r.percentile): r.value for r in df.collect()}
    got, want = of(got), of(want)
    assert got.keys() == want.keys() and got
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-12) or math.isnan(v) and math.isnan(got[k])), k


@pytest.mark.parametrize("members", [1 << 16, 2])
def test_percentiles_of_points(spark, monkeypatch, members):
    wide, obs, ctl, _, _ = made(spark)
    obs = obs.filter("not (member = 'o1' and t = 29)")
    coef = at.coefficients(wide, obs, ctl, V, 0, 20).persist()
    monkeypatch.setattr(at, "MEMBERS", members)
    monkeypatch.setattr(sumset, "FEW", 2)
    monkeypatch.setattr(sumset, "POINTS", 7)
    monkeypatch.setattr(sumset, "HELD", 1)
    # A step that is missing, and one that is NaN.
    odd = wide.withColumn("GHG", F.when(F.col("t") == 3, None).when(F.col("t") == 4, float("nan")).otherwise(F.col("GHG")))
    for responses, const in ((wide, 1.0), (odd, 0.0)):
        keys = ["t", "variable"]
        want = sumset.percentiles(at.sums(responses, coef, V, obs, const), keys)
        same(sumset.percentiles(at.linear(responses, at.met(coef, V), V, obs, const), keys), want, keys)
        monkeypatch.setattr(sumset, "BROADCAST", 1)
    sized = sumset.percentiles(at.linear(wide, at.met(coef, V), V).over(lambda p: p.filter("t < 2")), ["variable"], [50.0], size="n")
    want = at.sums(wide.filter("t < 2"), coef, V).groupBy("variable").agg(F.sum(F.size("a") * F.size("c")).alias("n"))
    assert {r.variable: r.n for r in sized.collect()} == {r.variable: r.n for r in want.collect()}


def test_growing_ranges(spark):
    wide, obs, ctl, _, _ = made(spark)
    coef = at.growing_coefficients(wide, obs, ctl, V, 0, 18, 20)
    each, on = wide.filter("t < 3").crossJoin(coef.select("end_step").distinct()), ["end_step"]
    keys = ["end_step", "t", "variable"]
    same(sumset.percentiles(at.linear(each, at.met(coef, V, on), V, on=on), keys), sumset.percentiles(at.sums(each, coef, V, on=on), keys), keys)
    assert sumset.percentiles(at.linear(each.filter("false"), at.met(coef, V, on), V, on=on), keys).collect() == []


def test_what_is_written_does_not_grow_with_the_points(spark):
    rng = np.random.default_rng(5)
    members = 3000
    coef = spark.createDataFrame([("m", "e", k, f"{k}{i}", *rng.normal(size=4).tolist()) for k, n in (("obs", 3), ("ctl", members)) for i in range(n)], "model string, ensemble string, kind string, target string, b_GHG double, b_Nat double, b_OHF double, b_const double")
    wide = spark.createDataFrame([("m", "e", t, *rng.normal(size=3).tolist()) for t in range(40)], "model string, ensemble string, t long, GHG double, Nat double, OHF double")
    before = len(stored._written)
    assert sumset.percentiles(at.linear(wide, at.met(coef, V), V), ["t", "variable"]).count() == 40 * 5 * 5
    size = sum(os.path.getsize(os.path.join(r, f)) for p in stored._written[before:] for r, _, files in os.walk(p.removeprefix("file://")) for f in files)
    assert size < 40 * 5 * members * 8 / 4  # a quarter of the arrays


def test_bounds_of_pairs_in_bucketed_tables(spark):
    wide, obs, ctl, _, _ = made(spark)
    coef = at.coefficients(wide, obs, ctl, V, 0, 20).persist()
    sides = at.sides(coef, V, bucket=True)
    few = at.linear(wide, None, V).over(lambda p: p.filter("variable = 'Tot'").withColumn("m", F.col("model")))
    laid = sides.laid(sumset.grouped(few, ["m", "t"]))[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = laid.join(sides.obs.hint("merge"), sides.at).join(sides.ctl.hint("merge"), sides.at).select("points", "obs", "ctl")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == wide.select("model", "ensemble").distinct().count()  # coefficients once, not once a step
        got = {(r.m, r.t): r for r in sumset.bounds(both, {"m": "string", "t": "long"}).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {}
    for r in at.sums(wide, coef, V).filter("variable = 'Tot'").collect():
        want.setdefault((r.model, r.t), []).append(np.add.outer(r.a, r.c).ravel())
    assert got.keys() == want.keys()
    for k, parts in want.items():
        every = np.concatenate(parts)
        assert got[k].n == len(every) and np.allclose([got[k].lo, got[k].hi, got[k].total], [every.min(), every.max(), every.sum()])
