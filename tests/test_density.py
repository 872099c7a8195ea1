"""Densities by moments of cells."""

import numpy as np

from plumbline.operators import summary


def plain(v, x):
    h = v.std(ddof=1) * len(v) ** -0.2
    return np.exp(-(((x[:, None] - v) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))


def test_density_as_by_every_value(spark):
    rng = np.random.default_rng(1)
    groups = {"normal": rng.normal(size=3000), "two": np.r_[rng.normal(-50, 1, 40), rng.normal(70, 0.1, 60)], "few": np.array([1.0, 2.0]), None: rng.standard_cauchy(size=200), "same": np.ones(5)}
    df = spark.createDataFrame([(k, float(v)) for k, own in groups.items() for v in own] + [("few", None)], "k string, value double")
    for bounds in (None, (-3.0, 3.0)):
        got = {}
        for r in summary.kde(df, ["k"], 40, bounds=bounds).collect():
            got.setdefault(r.k, {})[r.i] = (r.x, r.density)
        assert got.keys() == groups.keys() - {"same"}
        for k, own in got.items():
            x, density = np.array([own[i] for i in range(40)]).T
            want = plain(groups[k], x)
            assert np.allclose(x, np.linspace(*(bounds or (groups[k].min(), groups[k].max())), 40))
            assert np.abs(density - want).max() <= 1e-9 * want.max() if want.max() else True
            h = groups[k].std(ddof=1) * len(groups[k]) ** -0.2
            assert np.abs(density - want).max() <= 1e-9 / h


def test_what_is_shuffled_are_cells(spark):
    df = spark.range(100_000).selectExpr("id % 2 as k", "sin(id) as value").repartition(4)
    cells = summary.kde(df, ["k"], 10)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum(POWER(" in plan.replace("pow", "POWER") or "partial_sum" in plan  # moments are added up before the exchange
    assert cells.count() == 20


def test_few_values_are_summed_directly(spark, monkeypatch):
    rng = np.random.default_rng(9)
    groups = {"few": rng.normal(size=27), "more": rng.normal(size=60), "equal": np.ones(5), "one": np.ones(1), None: rng.normal(size=20)}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("few", None)], "k string, value double")
    bounds = (-2.0, 2.0)
    assert "_values" in summary.kde(df, ["k"], 7, bounds=bounds)._jdf.queryExecution().toString()
    for most in (1024, 30, 0):  # all directly, some, none
        monkeypatch.setattr(summary, "FEW_VALUES", most)
        got = {(r.k, r.i): (r.x, r.density) for r in summary.kde(df, ["k"], 7, bounds=bounds).collect()}
        assert len(got) == 3 * 7
        for (k, i), (x, density) in got.items():
            v = groups[k]
            h = v.std(ddof=1) * len(v) ** -0.2
            assert abs(x - (-2 + 4 * i / 6)) < 1e-12
            assert abs(density - np.exp(-0.5 * ((x - v) / h) ** 2).mean() / h / np.sqrt(2 * np.pi)) < 1e-9
