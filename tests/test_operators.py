"""Hand-made cases of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution as at
from plumbline.operators import products, regression, response, selection, summary
from plumbline.operators import timeseries as ts
from plumbline.plans import config
from plumbline.sources import forcing as fo


def series(spark, values, key="s"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, t long, value double")


def test_ols_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 3))
    y = 0.5 * x[:, 0] - 1.2 * x[:, 1] + 0.3 * x[:, 2] + 0.7
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "k int, a double, b double, c double, y double")
    for fit in (regression.ols, regression.lstsq):
        got = fit(df, ["k"], ["a", "b", "c"]).first()
        assert np.allclose([got.b_a, got.b_b, got.b_c, got.b_const], [0.5, -1.2, 0.3, 0.7])


def test_collinear_regressors(spark):
    df = spark.createDataFrame([(1, float(i), float(i), 2.0 * i + 1) for i in range(10)], "k int, a double, b double, y double")
    assert regression.ols(df, ["k"], ["a", "b"]).first().b_a is None
    got = regression.lstsq(df, ["k"], ["a", "b"]).first()
    assert np.allclose([got.b_a, got.b_b, got.b_const], [1, 1, 1])


def test_ramp(spark):
    ramp = series(spark, range(40))
    end = ts.trend(ramp, ["k"], 16).collect()
    assert len(end) == 25 and all(math.isclose(r.slope, 1) and math.isclose(r.end, r.t) for r in end)
    assert all(math.isclose(r.ma, r.t - 1) for r in ts.moving_average(ramp, ["k"], 3).collect())


def test_even_windows_are_full_or_null(spark):
    df = series(spark, range(37))
    assert ts.centred_mean(df, ["k"], 20, "m").filter("m is not null").count() == 18
    assert ts.centred_mean(df, ["k"], 30, "m").filter("m is not null").count() == 8


@pytest.mark.parametrize(("length", "slices"), [(100, 0), (174, 1), (351, 3), (500, 4)])
def test_segments(spark, length, slices):
    got = ts.segments(series(spark, range(length)), ["k"], 174, 50)
    assert got.select("slice_start").distinct().count() == slices
    assert got.count() == 174 * slices
    assert got.filter("t < 50").groupBy("slice_start").agg(F.abs(F.avg("value")).alias("m")).filter("m > 1e-9").isEmpty()


def test_filter_is_strict(spark):
    flat = series(spark, [0.0] * 40, "flat")
    edge = series(spark, [0.3] * 20 + [-0.1] * 20, "edge")
    good = series(spark, [0.08 if i % 20 < 10 else -0.08 for i in range(40)], "good")
    got = ts.in_range(flat.union(edge).union(good), ["k"], (3, 0.3, 0.06), (30, 0.1)).collect()
    assert [r.k for r in got] == ["good"]


def test_signal_keeps_length_and_extends(spark):
    got = {r.t: r.signal for r in ts.signal(series(spark, range(20)), ["k"], 5).collect()}
    assert sorted(got) == list(range(20))
    assert math.isclose(got[19], 19) and math.isclose(got[0], (0 + 0 + 0 + 1 + 2) / 5)
    assert ts.signal(series(spark, range(6)), ["k"], 1).count() == 6


def test_percentiles_propagate_nan_and_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", float("nan")), ("c", 1.0), ("c", None)], "k string, value double")
    got = {(r.k, r.percentile): r.value for r in summary.percentiles(df, ["k"]).collect()}
    assert got["a", 50.0] == 1.5 and math.isnan(got["b", 5.0]) and got["c", 50.0] is None


def test_weighted_mean(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 3.0, 3), ("y", 1.0, 1)], "k string, value double, weight int")
    assert {r.k: r.value for r in summary.weighted_mean(df, ["k"], 2).collect()} == {"x": 2.5, "y": None}


def test_sample_of_all_is_identity(spark):
    df = spark.range(10)
    assert summary.sampled(df, "id", 99).count() == 10
    assert [r.id for r in summary.sampled(df, "id", 4).collect()] == [r.id for r in summary.sampled(df.repartition(3), "id", 4).collect()]


def test_box_response_closed_form(spark):
    f = spark.createDataFrame([("GHG", "e", i, float(i % 5)) for i in range(12)], "variable string, ensemble string, t long, value double")
    p = spark.createDataFrame([("m", 1, 2.0, 0.5), ("m", 2, 1e5, 0.3)], "model string, box long, d double, q double")
    want = [sum(q * (s % 5) * -math.expm1(-1 / d) * math.exp(-(t - s) / d) for d, q in ((2.0, 0.5), (1e5, 0.3)) for s in range(t + 1)) for t in range(12)]
    got = [r.value for r in response.box_response(f, p).orderBy("t").collect()]
    assert np.allclose(got, want, rtol=1e-12)
    mid = [r.value for r in response.box_response(f, p, midpoint=True).orderBy("t").collect()]
    assert np.allclose(mid, [(a + b) / 2 for a, b in zip([0, *want], want, strict=False)])


def test_functional_before_pairing_equals_per_member(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"e{e}", v, t, float(x)) for e in range(2) for v in at.VARIABLES for t, x in enumerate(rng.normal(size=20))]
    resp = spark.createDataFrame(rows, "model string, ensemble string, variable string, t long, value double")
    target = lambda p: spark.createDataFrame([(f"{p}{k}", t, float(x)) for k in range(3) for t, x in enumerate(rng.normal(size=20))], "member string, t long, value double")
    obs, ctl = target("o").cache(), target("c").cache()
    wide = at.wide(resp, at.VARIABLES)
    pairs = at.paired(at.coefficients(wide, obs, ctl, at.VARIABLES, 0, 19), at.VARIABLES)
    keys = ["model", "ensemble", "obs", "ctl"]
    per = ts.trend(at.long(at.attributed(wide, pairs, at.VARIABLES), ["Tot"], [*keys, "t"]).drop("variable"), keys, 16).filter("t = 19")
    first = ts.trend(resp, ["model", "ensemble", "variable"], 16).filter("t = 19").select("model", "ensemble", "variable", "t", F.col("end").alias("value"))
    after = at.attributed(at.wide(first, at.VARIABLES), pairs, at.VARIABLES)
    both = per.join(after, keys).select("end", "Tot").collect()
    assert len(both) == 18 and all(math.isclose(r.end, r.Tot, abs_tol=1e-9) for r in both)


def test_selected_percentiles(spark):
    """Selection gives the percentiles of a buffer, with ties, single values, NaN and missing values, and few bins."""
    rng = np.random.default_rng(4)
    rows = [(k, float(x)) for k, n in (("a", 1000), ("b", 1), ("c", 2), (None, 37)) for x in rng.normal(size=n) ** 3]
    rows += [("ties", float(x)) for x in rng.integers(0, 4, 500)] + [("flat", 2.0)] * 9 + [("nan", 1.0), ("nan", float("nan")), ("missing", 1.0), ("missing", None), ("far", 1e300), ("far", 0.0), ("far", 1.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    of = lambda got: {(r.k, r.percentile): r.value for r in got.collect()}
    want = of(summary.percentiles(df, ["k"]))
    for bins in (4096, 3):
        got = of(selection.percentiles(df, ["k"], bins=bins))
        assert got.keys() == want.keys()
        for key, v in want.items():
            assert (got[key] is None) == (v is None) and (v is None or math.isnan(v) and math.isnan(got[key]) or math.isclose(got[key], v, rel_tol=1e-12, abs_tol=1e-15)), key
    assert selection.percentiles(df.limit(0), ["k"]).count() == 0


def test_dependent_regressors(spark):
    """Nearly dependent regressors get the minimum-norm solution, and others keep the closed form."""
    rng = np.random.default_rng(6)
    rows = []
    for k in ("free", "same", "near", "constant"):
        for t in range(30):
            a, b = rng.normal(size=2)
            b = {"same": 2 * a, "near": a + 1e-9 * b, "constant": 3.0}.get(k, b)
            rows.append((k, float(a), float(b), float(2 * a - b + 1 + 0.1 * rng.normal())))
    df = spark.createDataFrame(rows, "k string, a double, b double, y double")
    got = {r.k: (r.b_a, r.b_b, r.b_const) for r in regression.fit(df, ["k"], ["a", "b"]).collect()}
    for k in ("free", "same", "near", "constant"):
        own = np.array([r[1:] for r in rows if r[0] == k])
        design = np.column_stack([own[:, :2], np.ones(len(own))])
        want = np.linalg.lstsq(design, own[:, 2], rcond=None)[0]
        assert np.allclose(got[k], want, rtol=1e-6), k
    assert {r.k for r in regression.ols(df, ["k"], ["a", "b"]).filter("b_a is null").collect()} == {"same", "near", "constant"}


def test_orthogonal_factors(spark):
    """Merged factors give the fit of all rows at conditions where covariances fail, for one key with most rows, null keys and rows that lack numbers."""
    rng = np.random.default_rng(12)
    data = {}
    for k, n in (("hot", 6000), ("few", 3), (None, 40), ("same", 900)):
        a = np.cumsum(rng.normal(size=n)) if k == "hot" else rng.normal(size=n)
        b = 5.0 + a + 2e-10 * np.abs(a).max() * rng.normal(size=n) if k == "hot" else rng.normal(size=n)
        if k == "same":  # repeated rows have one factor in every block
            a, b = np.full(n, 2.0), np.full(n, -1.0)
        data[k] = (a, b, a - 2 * b + 3)
    rows = [(k, float(a), float(b), float(y)) for k, own in data.items() for a, b, y in zip(*own, strict=True)]
    rows += [("few", None, 1.0, 1.0), ("few", math.inf, 1.0, 1.0), ("hot", 1.0, 1.0, math.nan), ("none", None, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, y double").repartition(16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        parts = regression.factors(df.withColumn("one", F.lit(1.0)), ["k"], ["a", "b", "one", "y"], merged=8)
        assert parts.filter("k = 'hot'").count() <= 8 and {r.k: r.n for r in parts.groupBy("k").agg(F.sum("_rows").alias("n")).collect()} == {"hot": 6000, "few": 3, None: 40, "same": 900}
        got = {r.k: [r.b_a, r.b_b, r.b_const] for r in regression.lstsq(df, ["k"], ["a", "b"], merged=8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(data)
    for k, (a, b, y) in data.items():
        design = np.column_stack([a, b, np.ones(len(a))])
        assert k != "hot" or np.linalg.cond(design) > 1e9
        assert np.allclose(got[k], np.linalg.lstsq(design, y, rcond=None)[0], rtol=1e-4), k
    assert np.allclose(got["hot"], [1, -2, 3], rtol=1e-4)
    by_covariances = regression.ols(df, ["k"], ["a", "b"]).filter("k = 'hot'").first()
    assert by_covariances.b_a is None or not np.allclose([by_covariances.b_a, by_covariances.b_b], [1, -2], rtol=1e-2)
    none = regression.lstsq(df.filter("k = 'none'"), ["k"], ["a", "b"])
    assert none.count() == 0 and none.columns == ["k", "b_a", "b_b", "b_const"]


def test_coefficients_of_gaps(spark):
    """Targets with all steps, with gaps and with repeated steps get the fit of their own rows, dependent regressors included."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2, 25, 2))
    x[1, :, 1] = 3 * x[1, :, 0]
    wide = spark.createDataFrame([("m", f"e{e}", t, float(x[e, t, 0]), float(x[e, t, 1])) for e in range(2) for t in range(25)], "model string, ensemble string, t long, Ant double, Nat double")
    steps = {"whole": list(range(30)), "gaps": [t for t in range(25) if t % 3], "twice": [*range(25), 4]}
    y = {k: rng.normal(size=len(s)) for k, s in steps.items()}
    obs = spark.createDataFrame([(k, t, float(v)) for k, s in steps.items() for t, v in zip(s, y[k], strict=True)], "member string, t long, value double")
    got = {(r.ensemble, r.target): (r.b_Ant, r.b_Nat, r.b_const) for r in at.coefficients(wide, obs, obs.limit(0), ["Ant", "Nat"], 0, 24).collect()}
    assert len(got) == 6
    for (e, k), b in got.items():
        use = [i for i, t in enumerate(steps[k]) if t < 25]
        design = np.array([[*x[int(e[1]), steps[k][i]], 1.0] for i in use])
        assert np.allclose(b, np.linalg.lstsq(design, y[k][use], rcond=None)[0])


def test_fewer_variables(spark):
    """One and two regressed variables: the total holds the constant, and of one it is written over the part."""
    rng = np.random.default_rng(8)
    forcing = rng.normal(size=(2, 20))
    y = {"o": 1.5 * forcing[0] + 0.5 * forcing[1] + 0.3, "c": rng.normal(size=20) * 0.1}
    target = lambda k: spark.createDataFrame([(k, t, float(x)) for t, x in enumerate(y[k])], "member string, t long, value double")
    for names in (["Ant", "Nat"], ["Tot"]):
        cols = {"Ant": forcing[0], "Nat": forcing[1], "Tot": forcing.sum(axis=0)}
        wide = spark.createDataFrame([("m", "e", t, *(float(cols[v][t]) for v in names)) for t in range(20)], f"model string, ensemble string, t long, {', '.join(f'{v} double' for v in names)}")
        got = at.attributed(wide, at.paired(at.coefficients(wide, target("o"), target("c"), names, 0, 19), names), names).orderBy("t").collect()
        design = np.column_stack([*(cols[v] for v in names), np.ones(20)])
        b = np.linalg.lstsq(design, y["o"], rcond=None)[0] + np.linalg.lstsq(design, y["c"], rcond=None)[0]
        assert got[0].asDict().keys() == {"model", "ensemble", "obs", "ctl", "t", *names, "Tot"}
        assert np.allclose([r.Tot for r in got], design @ b) and (names == ["Tot"] or np.allclose([r.Ant for r in got], b[0] * cols["Ant"]))


def test_products(spark):
    runs = spark.createDataFrame([(y, t, "Tot", 50.0, float(10 * y + t)) for y in (3, 4, 5) for t in range(y + 1)], "end_step long, t long, variable string, percentile double, value double")
    new, revised = products.deltas(runs)
    assert {r.end_step: r.value for r in new.collect()} == {3: 1.0, 4: 1.0, 5: 1.0}
    assert {r.end_step: r.value for r in revised.collect()} == {4: 10.0, 5: 10.0}
    beyond = spark.createDataFrame([(y, t, "Tot", 50.0, float(10 * y + t)) for y in (3, 4, 5) for t in range(7)], runs.schema)
    assert {r.end_step: r.value for r in products.constrained(beyond).collect()} == {3: 35.0, 4: 45.0, 5: 55.0}
    assert {r.end_step: r.value for r in products.deltas(beyond)[1].collect()} == {4: 10.0, 5: 10.0}
    named = spark.createDataFrame([(9, "0-9", 0.0), (10, "1-10", 2.0), (10, "0-9", 5.0)], "end_step long, label string, value double")
    assert [r.label for r in products.historical_only(named, "AR6").collect()] == ["1-10"]


def test_config():
    assert config.derived_variables(["OHF", "GHG", "Nat"]) == ["Ant", "Tot", "Res"]
    assert config.derived_variables(["Tot"]) == ["Res"] and config.derived_variables(["Nat", "Ant"]) == ["Tot", "Res"]
    with pytest.raises(ValueError):
        config.derived_variables(["GHG"])
    assert config.contiguous([3, 1, 2]) and not config.contiguous([1, 3])
    run = config.RunConfig.from_args(["--regress-range=1850-2023", "--headline-toggles=annual,SR1.5", "--samples=9", "--include-rate=n"])
    assert run.regress == (1850, 2023) and run.headlines == ("ANNUAL", "SR15") and not run.include_rate and run.output_range == (1850, 2023)
    assert config.RunConfig.from_args(["--headline-toggles=n"]).headlines == ()
    assert config.headline_years("IGCC", 2024, 2024, "AR6") == [2019, 2024] and config.headline_years("2000,1990", 1, 1) == [1990, 2000]
    assert config.clamp((1850, 2100), (1750, 2024)) == (1850, 2024)
    for bad in ("1850", "2000-1900"):
        with pytest.raises(ValueError):
            config.parse_range(bad)


def test_forcing_sources(spark):
    raw = spark.createDataFrame([("a", v, i, float(i + t)) for i, v in enumerate(("GHG", "Nat", "OHF")) for t in range(3)], "ensemble string, variable string, i int, value double").withColumn("t", (F.col("value") - F.col("i")).cast("int")).drop("i")
    got = fo.complete(raw, ["Ant", "Nat"])
    assert {(r.variable, r.t): r.value for r in got.collect()}["Ant", 1] == 1.0 + 3.0
    with pytest.raises(ValueError):
        fo.complete(raw, ["Vol"])
    with pytest.raises(ValueError):
        fo.member(raw, "z")
    assert fo.same_members(raw) and fo.kind_of("observed-SSP-extension") == "ssp" and fo.kind_of("observed-2024") == "observed"
    path = spark.createDataFrame([("SSP245", "aerosol", "c", 2000.5, 1.0), ("ssp245", "other", "c", 2000.9, 2.0), ("ssp245", "ghg", "c", 2001.5, 4.0), ("ssp585", "ghg", "c", 2001.5, 9.0)], "scenario string, variable string, ensemble string, year double, value double")
    assert sorted((r.variable, r.t, r.value) for r in fo.ssp(path, "SSP245").collect()) == [("GHG", 2001, 4.0), ("OHF", 2000, 3.0)]
    assert fo.replicate(raw.filter("variable = 'GHG'"), spark.createDataFrame([("x",), ("y",)], "ensemble string")).count() == 6
