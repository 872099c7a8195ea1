"""Percentiles of sums of two sets, and growing regressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution as at
from plumbline.operators import products, regression, sumset

QS = [0.0, 5.0, 17.0, 50.0, 83.0, 95.0, 100.0]


def rows_of(groups):
    return [(k, a.tolist(), c.tolist()) for k, pairs in groups.items() for a, c in pairs]


def check(spark, groups, qs=QS):
    got = {(r.k, r.percentile): r.value for r in sumset.percentiles(spark.createDataFrame(rows_of(groups), "k string, a array<double>, c array<double>"), ["k"], qs).collect()}
    for k, pairs in groups.items():
        every = np.concatenate([np.add.outer(a, c).ravel() for a, c in pairs])
        for q in qs:
            assert math.isclose(got[k, q], np.percentile(every, q), rel_tol=1e-12, abs_tol=1e-300), (k, q, got[k, q])
    assert len(got) == len(groups) * len(qs)


def test_as_by_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    groups = {"small": [(rng.normal(size=3), rng.normal(size=4))], "one": [(np.array([1.0]), np.array([2.0]))], None: [(rng.normal(size=7), rng.normal(size=9))], "long left": [(rng.normal(size=300), rng.normal(size=4)), (rng.normal(size=2), rng.normal(size=5))]}
    groups["ties"] = [(rng.integers(0, 3, 50).astype(float), rng.integers(0, 3, 60).astype(float))]
    groups["equal"] = [(np.zeros(70), np.zeros(80))]
    groups["tiny and great"] = [(10.0 ** rng.uniform(-300, 300, 40) * rng.choice([-1, 1], 40), np.zeros(50)), (np.zeros(40), np.full(40, -0.0))]
    groups["near"] = [(1 + rng.integers(0, 5, 40) * 2.0**-52, rng.integers(0, 5, 40) * 2.0**-53)]
    check(spark, groups)
    for few in (0, 3, 100):
        monkeypatch.setattr(sumset, "FEW", few)
        check(spark, groups)


def test_large_sides(spark):
    rng = np.random.default_rng(2)
    check(spark, {"a": [(rng.normal(size=400), rng.standard_cauchy(size=2500)), (rng.normal(3, size=100), rng.normal(size=900))], "b": [(np.round(rng.normal(size=300), 1), np.round(rng.normal(size=900), 1))]})


def test_rows_do_not_grow_with_pairs(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(rows_of({"a": [(rng.normal(size=2000), rng.normal(size=2000))]}), "k string, a array<double>, c array<double>")
    plan = sumset.percentiles(df, ["k"])._jdf.queryExecution().toString()
    assert "Generate explode" not in plan.split("== Physical Plan ==")[0] or "CartesianProduct" not in plan
    every = sumset.percentiles(df, ["k"], [50.0]).first().value
    a, c = (np.array(x) for x in df.select("a", "c").first())
    assert math.isclose(every, np.percentile(np.add.outer(a, c), 50), rel_tol=1e-12)  # of four million pairs


def test_missing_and_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([("n", [1.0, nan], [1.0]), ("m", [1.0, None], [1.0]), ("good", [1.0, 2.0], [1.0]), ("good", [], [5.0]), ("none", [], [])], "k string, a array<double>, c array<double>")
    got = {r.k: r.value for r in sumset.percentiles(df, ["k"], [50.0]).collect()}
    assert math.isnan(got["n"]) and got["m"] is None and got["good"] == 2.5 and "none" not in got
    assert sumset.percentiles(df.limit(0), ["k"]).collect() == []


def test_counts_as_the_sums_are_rounded():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, c = rng.normal(size=rng.integers(1, 30)) * 10.0 ** rng.integers(-8, 8), rng.normal(size=rng.integers(1, 30))
        every = np.add.outer(a, c).ravel()
        x = np.sort(np.r_[every, np.nextafter(every, np.inf), np.nextafter(every, -np.inf)])
        assert (sumset.counts_upto(a, c, x) == (every[None, :] <= x[:, None]).sum(axis=1)).all()
        lo, hi = np.sort(rng.choice(every, 2))
        assert sorted(sumset.listed(a, c, lo, hi)) == sorted(every[(every > lo) & (every <= hi)])


def test_intervals_are_listed_after_one_sort(monkeypatch):
    rng, sorts = np.random.default_rng(5), []
    a, c = rng.normal(size=5), rng.normal(size=400)
    every = np.add.outer(a, c).ravel()
    lo = np.sort(every)[[10, 500, 500, 1900]]
    hi = np.sort(every)[[40, 530, 500, 1999]]
    want = [sumset.listed(a, c, *x) for x in zip(lo, hi, strict=True)]
    sort = np.sort
    monkeypatch.setattr(np, "sort", lambda x: sorts.append(len(x)) or sort(x))
    got = sumset.listed_each(a, c, lo, hi)
    assert sorts == [400] and [len(x) for x in got] == [30, 30, 0, 99]
    assert all((x == y).all() for x, y in zip(got, want, strict=True))


def made(spark, n=30, members=3, controls=5, seed=5):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(size=(2, n, 3)), axis=1)
    wide = spark.createDataFrame([(f"m{m}", "e", t, *map(float, x[m, t])) for m in range(2) for t in range(n)], "model string, ensemble string, t long, GHG double, Nat double, OHF double")
    y = {("obs", f"o{i}"): np.cumsum(rng.normal(size=n)) for i in range(members)} | {("ctl", f"c{i}"): rng.normal(size=n) for i in range(controls)}
    frame = lambda kind: spark.createDataFrame([(k[1], t, float(v)) for k, s in y.items() if k[0] == kind for t, v in enumerate(s)], "member string, t long, value double")
    return wide, frame("obs"), frame("ctl"), x, y


def test_growing_fits_are_those_of_their_ranges(spark):
    wide, obs, ctl, x, y = made(spark)
    got = at.growing_coefficients(wide, obs, ctl, ["GHG", "Nat", "OHF"], 0, 12, 29).collect()
    assert len(got) == 2 * len(y) * 19
    for r in got:
        n = r.end_step + 1
        design = np.column_stack([x[int(r.model[1]), :n], np.ones(n)])
        want = np.linalg.lstsq(design, y[r.kind, r.target][:n], rcond=None)[0]
        assert np.allclose([r.b_GHG, r.b_Nat, r.b_OHF, r.b_const], want, rtol=1e-8, atol=1e-9)


def test_growing_fits_of_near_dependent_regressors(spark):
    rng = np.random.default_rng(6)
    t = np.arange(60.0)
    design = np.column_stack([t, t**2 / 60, t + 1e-5 * rng.normal(size=60)])
    df = spark.createDataFrame([(1, int(i), *map(float, row)) for i, row in enumerate(design)], "k int, t long, a double, b double, c double")
    row = regression.growing_weights(df, ["k"], ["a", "b", "c"], 30).first()
    y = rng.normal(size=60)
    b = np.array([np.dot(row.start[c], y[:30]) for c in ("a", "b", "c", "const")])
    for s in row.steps[30:]:
        x = np.array([s.x_a, s.x_b, s.x_c, 1.0])
        b = b + np.array([s.k_a, s.k_b, s.k_c, s.k_const]) * (y[s.t] - x @ b)
    want = np.linalg.lstsq(np.column_stack([design, np.ones(60)]), y, rcond=None)[0]
    assert np.allclose(b, want, rtol=1e-5)
    same = df.withColumn("c", F.col("a"))
    assert regression.growing_weights(same, ["k"], ["a", "b", "c"], 30).collect() == []


def test_sums_are_the_pairs(spark, monkeypatch):
    wide, obs, ctl, _, _ = made(spark)
    variables = ["GHG", "Nat", "OHF"]
    obs = obs.filter("not (member = 'o1' and t = 29)")
    coef = at.coefficients(wide, obs, ctl, variables, 0, 20).persist()
    pairs = at.attributed(wide, at.paired(coef, variables), variables, obs)
    want = {}
    for r in pairs.collect():
        for v in (*variables, "Ant", "Tot", "Res"):
            if r[v] is not None:
                want.setdefault((r.model, r.t, v), []).append(r[v])
    for members in (1 << 16, 2):  # in one array a side, and in several
        monkeypatch.setattr(at, "MEMBERS", members)
        got = {}
        for r in at.sums(wide, coef, variables, obs).collect():
            got.setdefault((r.model, r.t, r.variable), []).extend(np.add.outer(r.a, r.c).ravel())
        assert got.keys() == want.keys()
        for k in want:
            assert np.allclose(sorted(got[k]), sorted(want[k]), rtol=1e-9, atol=1e-12)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("members", [1 << 16, 2])
def test_bucketed_sides_meet_without_exchange(spark, monkeypatch, members):
    wide, obs, ctl, _, _ = made(spark)
    variables = ["GHG", "Nat", "OHF"]
    obs = obs.filter("not (member = 'o1' and t = 29)")
    coef = at.coefficients(wide, obs, ctl, variables, 0, 20).persist()
    rows = lambda df: sorted((r.model, r.ensemble, r.t, r.variable, round(x, 8)) for r in df.collect() for x in np.add.outer(r.a, r.c).ravel())
    monkeypatch.setattr(at, "MEMBERS", members)
    monkeypatch.setattr(at, "BUCKET", 3)
    broadcast = at.sides(coef, variables)
    assert broadcast.buckets == 0
    monkeypatch.setattr(at, "MOST_COEFFICIENTS", 1)
    own = at.sides(coef, variables)
    assert own.buckets > 1
    laid, n = own.laid(wide)
    assert n == wide.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = at.sums(laid, own, variables)
        assert "SortMergeJoin" in _plan(got) and "Exchange" not in _plan(got)
        whole = at.sums(laid, own, variables, obs)  # measurements are few and by step
        assert rows(whole) == rows(at.sums(wide, broadcast, variables, obs))
        # A filter keeps the layout, and responses of another layout are moved alone.
        assert "Exchange" not in _plan(at.sums(laid.filter("t > 3"), own, variables))
        assert _plan(at.sums(wide, own, variables)).count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketed_sides_of_growing_ranges_and_of_nothing(spark):
    wide, obs, ctl, _, _ = made(spark)
    variables = ["GHG", "Nat", "OHF"]
    coef = at.growing_coefficients(wide, obs, ctl, variables, 0, 18, 20)
    own = at.sides(coef, variables, ["end_step"], bucket=True)
    each = wide.filter("t < 3").crossJoin(coef.select("end_step").distinct())
    got = at.sums(own.laid(each)[0], own, variables, on=["end_step"])
    want = at.sums(each, coef, variables, on=["end_step"])
    rows = lambda df: sorted((r.end_step, r.model, r.t, r.variable, round(x, 8)) for r in df.collect() for x in np.add.outer(r.a, r.c).ravel())
    assert rows(got) == rows(want) != []
    none = at.sides(coef.filter("false"), variables, ["end_step"], bucket=True)
    assert none.buckets == 0 and at.sums(none.laid(each)[0], none, variables, on=["end_step"]).count() == 0


def test_stored_tables_are_deleted(spark):
    from plumbline.sources import stored

    before, stored._written[:], names, stored._named[:] = stored._written[:], [], stored._named[:], []
    try:
        df = stored.bucketed(spark.range(100).selectExpr("id", "id % 7 AS k"), ["k"], 3)
        assert df.count() == 100 and df.groupBy("k").count().count() == 7
        name = stored._named[0]
        stored.forget(spark)
        assert not spark.catalog.tableExists(name)
    finally:
        stored._written[:], stored._named[:] = before, names


def test_targets_with_gaps(spark):
    wide, obs, ctl, x, y = made(spark)
    gone = obs.filter("not (member = 'o2' and t in (3, 7))")
    got = {(r.model, r.kind, r.target): r for r in at.coefficients(wide, gone, ctl, ["GHG", "Nat", "OHF"], 0, 29).collect()}
    assert len(got) == 2 * len(y)
    for (m, kind, target), r in got.items():
        keep = np.array([not (target == "o2" and t in (3, 7)) for t in range(30)])
        want = np.linalg.lstsq(np.column_stack([x[int(m[1])], np.ones(30)])[keep], y[kind, target][keep], rcond=None)[0]
        assert np.allclose([r.b_GHG, r.b_Nat, r.b_OHF, r.b_const], want, rtol=1e-7, atol=1e-8)


@pytest.mark.parametrize("n", [28, 45])
def test_full_information(spark, n):
    rng = np.random.default_rng(7)
    series, measured = rng.normal(size=n), rng.normal(size=n)
    of = lambda x: spark.createDataFrame([("Tot", t, float(v)) for t, v in enumerate(x)], "variable string, t long, value double")
    got = {(r.definition, r.t): (r.value, r.less_measured) for r in products.full_information(of(series), of(measured)).collect()}
    widths = {"ANNUAL": (0, 0), "AR6": (9, 0), "SR15": (15, 14), "CGWL": (10, 9)}
    full = lambda x, t, a, b: x[t - a : t + b + 1].mean() if t >= a and t + b < n else None
    for (d, t), (value, less) in got.items():
        want, base = full(series, t, *widths[d]), full(measured, t, 10, 9)
        assert value is None if want is None else math.isclose(value, want, abs_tol=1e-12)
        assert less is None if want is None or base is None else math.isclose(less, want - base, abs_tol=1e-12)
    assert len(got) == 4 * n
