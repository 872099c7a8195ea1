"""Whole runs from files to results, against NumPy."""

import math

import numpy as np
import pytest

from plumbline.plans import config, run
from plumbline.sources import files, forcing, scenarios

YEARS = np.arange(1850, 1890)
ERA = (1850, 1859)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Files of a scenario with one forcing member and one with natural members."""
    at, rng = tmp_path_factory.mktemp("files"), np.random.default_rng(5)
    table = lambda names, values, first="year": "\n".join([",".join([first, *names]), *(",".join(map(str, [y, *row])) for y, row in zip(YEARS, values, strict=True))]) + "\n"
    ramp = np.linspace(0, 2, len(YEARS))
    own = np.column_stack([ramp**2, rng.normal(size=len(YEARS)), 0.3 * np.sin(ramp * 9)])
    for name in ("SMILE_ESM-SSP245", "NorESM_rcp45-Volc"):
        (at / name).mkdir()
    (at / "SMILE_ESM-SSP245/ERF_M_ssp245.csv").write_text(table(["GHG", "Nat", "OHF"], own))
    (at / "SMILE_ESM-SSP245/ts_M_ssp245.csv").write_text(table(["r1", "r2", "r3"], 0.4 * ramp[:, None] + 0.1 * rng.normal(size=(len(YEARS), 3))))
    (at / "NorESM_rcp45-Volc/ERF_anthro_M.csv").write_text(table(["GHG", "OHF"], own[:, [0, 2]]))
    (at / "NorESM_rcp45-Volc/ERF_natural_M.csv").write_text(table(["1", "2"], rng.normal(size=(len(YEARS), 2))))
    for k in range(2):
        rows = "".join(f"   {1 + i}  0.0  {x}\n" for i, x in enumerate(0.15 * rng.normal(size=100)))
        (at / "piControl" / f"m{k}").mkdir(parents=True)
        (at / "piControl" / f"m{k}" / f"x_tas_Amon_M{k}_piControl_r1_gn.MAG").write_text("head\n   YEARS  NH  WORLD\n" + rows)
    (at / "parameters.csv").write_text(",A,A,B,B\n,1,2,1,2\nd,3,60,5,200\nq,0.4,0.3,0.2,0.5\n")
    return str(at)


def plain(inputs, settings):
    """Timeseries and headline values of every member, in NumPy."""
    rows = lambda df: [tuple(r) for r in df.collect()]
    series = {}
    for v, _, t, x in rows(inputs.forcing.select("variable", "ensemble", "t", "value")):
        series.setdefault(v, {})[t] = x
    boxes = {}
    for m, _, d, q in rows(inputs.parameters.select("model", "box", "d", "q")):
        boxes.setdefault(m, []).append((d, q))
    by = lambda df: {m: np.array([x for _, _, x in sorted(r for r in rows(df.select("member", "t", "value")) if r[0] == m)]) for m in sorted({r.member for r in df.select("member").distinct().collect()})}
    obs, ctl = by(inputs.temperature), by(inputs.control)
    names, out = sorted(settings.variables), {}
    era = slice(0, ERA[1] - ERA[0] + 1)
    for m, of in sorted(boxes.items()):
        cols = []
        for v in names:
            f = np.array([series[v][y] for y in YEARS])
            total = np.zeros(len(f))
            for d, q in of:
                state = 0.0
                for i, x in enumerate(f):
                    state = state * math.exp(-1 / d) + q * x * (1 - math.exp(-1 / d))
                    total[i] += state
            cols.append(total - total[era].mean())
        design = np.column_stack([*cols, np.ones(len(YEARS))])
        fit = lambda y: np.linalg.lstsq(design, y, rcond=None)[0]  # noqa: E731, B023
        for o, y in obs.items():
            for c, z in ctl.items():
                b = fit(y) + fit(z)
                parts = dict(zip(names, (design[:, :-1] * b[:-1]).T, strict=True))
                if {"GHG", "OHF"} <= set(names):
                    parts["Ant"] = parts["GHG"] + parts["OHF"]
                parts["Tot"] = design @ b
                parts["Res"] = y - parts["Tot"]
                out[m, o, c] = parts
    return out


@pytest.mark.parametrize("variables", [("GHG", "Nat", "OHF"), ("Ant", "Nat"), ("Tot",)])
def test_run(spark, root, tmp_path, variables):
    settings = config.RunConfig(scenario="SMILE_ESM-SSP245", preindustrial=ERA, regress=(1850, 2000), variables=variables, headline_years="end_regress", first_rate=1859)
    inputs = run.load(spark, root, settings)
    assert inputs.control.select("member").distinct().count() > 2
    members = plain(inputs, settings)
    at = str(tmp_path / "results")
    assert run.run(spark, settings, inputs, at) == len(members)
    got = {(r.label, r.variable, r.percentile): r.value for kind in ("timeseries", "headlines", "rates") for r in spark.read.parquet(f"{at}/{kind}").collect()}
    stack = lambda v: np.array([p[v] for p in members.values()])
    checked = 0
    for v in next(iter(members.values())):
        for q in settings.percentiles:
            x = stack(v)
            want = {str(y): np.percentile(x[:, i], q) for i, y in enumerate(YEARS)}
            if v != "Res":
                line = np.polyfit(np.arange(16), x[:, -16:].T, 1)
                want |= {"1889 (SR15 definition)": np.percentile(line[0] * 15 + line[1], q), "1880-1889": np.percentile(x[:, -10:].mean(axis=1), q)}
                want["1880-1889 (AR6 rate definition)"] = np.percentile(np.polyfit(np.arange(10), x[:, -10:].T, 1)[0], q)
            for label, w in want.items():
                assert math.isclose(got[label, v, q], w, rel_tol=1e-6, abs_tol=1e-8), (label, v, q)
                checked += 1
    assert checked == len(got) - sum(k[0].endswith("(AR6 rate definition)") and not k[0].startswith("1880") for k in got)


def test_run_of_bucketed_coefficients(spark, root, monkeypatch):
    settings = config.RunConfig.from_args(["--scenario=SMILE_ESM-SSP245", "--regress-range=1850-1889", "--preindustrial-era=1850-1859"])
    inputs = run.load(spark, root, settings)
    rows = lambda found: {k: sorted((r.label, r.variable, r.percentile, round(r.value, 9)) for r in df.collect()) for k, df in found.items()}
    want = rows(run.attribute(inputs, settings)[0])
    monkeypatch.setattr(run.at, "MOST_COEFFICIENTS", 1)
    monkeypatch.setattr(run.at, "BUCKET", 3)
    assert rows(run.attribute(inputs, settings)[0]) == want and want["timeseries"] and want["headlines"]


def test_repeats_are_combined(spark, root, tmp_path):
    settings = config.RunConfig(scenario="SMILE_ESM-SSP245", preindustrial=ERA, regress=(1850, 1889), samples=2, include_rate=False, headlines=("AR6",))
    inputs, at = run.load(spark, root, settings), str(tmp_path / "r")
    sizes = [run.run(spark, settings, inputs, at, repeat) for repeat in (0, 1)]
    assert sizes == [2 * 2 * 2] * 2 and files.catalog(spark, f"{at}/timeseries").count() == 1
    both = run.combine(spark, at)
    rows = spark.read.parquet(f"{at}/timeseries").filter("label = '1889' and variable = 'Ant' and percentile = 50").collect()
    assert len(rows) == 2 and rows[0].value != rows[1].value
    assert math.isclose(both.filter("label = '1889' and variable = 'Ant' and percentile = 50").first().value, sum(r.value for r in rows) / 2)
    run.export(both, str(tmp_path / "csv"))
    back = files.read_result_csv(spark, str(tmp_path / "csv"))
    assert {r.variable for r in back.select("variable").distinct().collect()} == {"Nat", "Ant", "Tot"} and back.count() == len(YEARS) * 3 * 5


def test_scenarios(spark, root):
    got = scenarios.load_forcing(spark, root, "NorESM_rcp45-Volc", ["GHG", "Nat", "OHF"])
    assert got.count() == 3 * 2 * len(YEARS) and forcing.same_members(got)
    assert scenarios.load_forcing(spark, root, "NorESM_rcp45-Volc", ["Ant", "Nat"], "2").select("variable", "ensemble").distinct().count() == 2
    with pytest.raises(ValueError):
        scenarios.load_forcing(spark, root, "NorESM_rcp45-Volc", ["Nat"], "7")
    # One forcing member serves any temperature member.
    assert scenarios.load_forcing(spark, root, "SMILE_ESM-SSP245", ["Tot"], "r2").count() == len(YEARS)
    assert scenarios.load_temperature(spark, root, "SMILE_ESM-SSP245", ERA, "r2").count() == len(YEARS)
    for era, member in (((1700, 1750), "all"), (ERA, "none")):
        with pytest.raises(ValueError):
            scenarios.load_temperature(spark, root, "SMILE_ESM-SSP245", era, member)
    with pytest.raises(ValueError):
        forcing.kind_of("else")


# -- numbers that the survey gives: N6 (50 baseline rows of control slices), N8 (limits), N12 (16 points), N13 (rates from 1950)


def control_file(at, values):
    (at / "piControl").mkdir(parents=True, exist_ok=True)
    for i, series in enumerate(values):
        rows = "".join(f"   {1 + k}  0.0  {x}\n" for k, x in enumerate(series))
        (at / "piControl" / f"x_tas_Amon_M{i}_piControl_r1_gn.MAG").write_text("head\n   YEARS  NH  WORLD\n" + rows)
    return str(at)


def test_control_limits(spark, tmp_path):
    # Long means of 0.12 pass a limit of 0.15 and not one of 0.1; those of 0.08 pass.
    wave = 0.05 * np.sign(np.sin(np.arange(60) / 2))
    step = np.r_[np.zeros(20), np.full(40, 1.0)]
    root = control_file(tmp_path, [wave + 0.12 * step, wave + 0.08 * step])
    of = lambda **how: {r.member.split("-")[0] for r in scenarios.load_control(spark, root, 60, 20, **how).select("member").distinct().collect()}
    assert of() == {"M1"} and of(long=(30, 0.15)) == {"M0", "M1"}


def test_experiments_are_apart(spark, tmp_path):
    root = control_file(tmp_path, [0.05 * np.sin(np.arange(60))])
    text = (tmp_path / "piControl/x_tas_Amon_M0_piControl_r1_gn.MAG").read_text()
    (tmp_path / "piControl/x_tas_Amon_M0_piControl2_r1_gn.MAG").write_text(text)
    got = scenarios.load_control(spark, root, 60, 20)
    assert got.select("member").distinct().count() == 2 and got.count() == 120


def test_baseline_rows(spark, root, tmp_path):
    settings = config.RunConfig(scenario="SMILE_ESM-SSP245", preindustrial=(1850, 1870), regress=(1850, 1889))
    inputs = run.load(spark, root, settings)
    first = lambda n: inputs.control.filter(f"t < {n}").groupBy("member").avg("value").collect()
    assert first(20) and all(abs(r[1]) < 1e-12 for r in first(20)) and any(abs(r[1]) > 1e-6 for r in first(21))


def test_trend_points_and_first_rate(spark):
    years, rng = np.arange(1935, 1956), np.random.default_rng(2)
    rows = lambda names, n: [(*k, int(y), float(x)) for k in names for y, x in zip(years[:n], rng.normal(size=n), strict=True)]
    forcing_ = spark.createDataFrame(rows([("Tot", "e")], 21), "variable string, ensemble string, t int, value double")
    obs = spark.createDataFrame(rows([("r1",)], 21), "member string, t int, value double")
    ctl = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(rng.normal(size=21))], "member string, t long, value double")
    params = spark.createDataFrame([("m", 1, 5.0, 0.5)], "model string, box int, d double, q double")
    settings = config.RunConfig(scenario="SMILE_ESM-SSP245", preindustrial=(1935, 1940), regress=(1935, 1955), variables=("Tot",), headlines=("SR15",))
    found, size = run.attribute(run.Inputs(forcing_, obs, ctl, params), settings)
    assert size == 1
    rates = {r.label for r in found["rates"].collect()}
    assert rates == {f"{y - 9}-{y} (AR6 rate definition)" for y in range(1950, 1956)}
    series = {int(r.label): r.value for r in found["timeseries"].filter("variable = 'Tot' and percentile = 50").collect()}
    last = np.array([series[y] for y in range(1940, 1956)])  # y - 15 to y
    line = np.polyfit(np.arange(16), last, 1)
    assert math.isclose(found["headlines"].filter("variable = 'Tot' and percentile = 50").first().value, line[0] * 15 + line[1], rel_tol=1e-9)


# -- matrices of runs, and what compares runs of growing ranges


END_YEARS, SHOWN = (1887, 1888, 1889), range(1850, 1890)


def value(end, label, variable, q, repeat):
    """Of a made-up run."""
    return (hash((label[-9:], variable)) % 1000) / 100 + q / 7 + (end - 1850) ** 2 / 900 + repeat / 8


def fake(inputs, settings, seed=""):
    repeat, end, spark = int(seed.rstrip("/")), settings.regress[1], inputs
    rows = lambda labels: spark.createDataFrame([(x, v, q, value(end, x, v, q, repeat)) for x in labels for v in ("Tot", "Ant", "Nat") for q in (5.0, 50.0)], "label string, variable string, percentile double, value double")
    return {"timeseries": rows(map(str, SHOWN)), "headlines": rows([f"{y - 9}-{y}" for y in END_YEARS])}, 8


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Results of runs that end in 1887, 1888 and 1889, two repeats each."""
    out, patch = str(tmp_path_factory.mktemp("matrix") / "r"), pytest.MonkeyPatch()
    patch.setattr(run, "attribute", fake)
    configs = [config.RunConfig(scenario="SMILE_ESM-SSP245", preindustrial=ERA, regress=(1850, y), truncate=(1850, 1889), samples=2) for y in END_YEARS]
    started = run.run_matrix(spark, configs[:1], 1, out, lambda c: spark)
    rest = run.run_matrix(spark, configs, 2, out, lambda c: spark)
    yield configs, out, started, rest
    patch.undo()


def test_matrix_starts_what_lacks(spark, grown, monkeypatch):
    configs, out, started, rest = grown
    assert [k for _, k in started] == [0] and [(c.regress[1], k) for c, k in rest] == [(1887, 1), (1888, 0), (1888, 1), (1889, 0), (1889, 1)]
    assert run.run_matrix(spark, configs, 2, out, lambda c: spark) == []
    before = run.combine(spark, out).count()
    write, calls = files.write_results, []

    def broken(df, path, keys):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        write(df, path, keys)

    monkeypatch.setattr(files, "write_results", broken)
    with pytest.raises(RuntimeError):
        run.run_matrix(spark, configs[:1], 3, out, lambda c: spark)
    monkeypatch.setattr(files, "write_results", write)
    median = lambda: run.combine(spark, out).filter("regressed_years = '1850-1887' and label = '1887' and variable = 'Tot' and percentile = 50").first().value
    half = median()
    assert run.combine(spark, out).count() == before and math.isclose(half, value(1887, "1887", "Tot", 50.0, 0.5))  # the half-written repeat is not read
    assert run.run_matrix(spark, configs[:1], 3, out, lambda c: spark) == [(configs[0], 2)] and math.isclose(median(), value(1887, "1887", "Tot", 50.0, 1))


def test_products_of_runs(spark, grown):
    _, out, _, _ = grown
    measured = np.random.default_rng(4).normal(size=len(SHOWN))
    temperature = spark.createDataFrame([(m, y, float(x) + d) for m, d in (("a", -1.0), ("b", 0.0), ("c", 3.0)) for y, x in zip(SHOWN, measured, strict=True)], "member string, t int, value double")
    values = {(r.regressed_years[-4:], r.label, r.variable, r.percentile): r.value for kind in ("timeseries", "headlines") for r in run.combine(spark, out, kind).collect()}
    of = lambda end, label, v="Tot", q=50.0: values[str(end), label, v, q]
    for definition, label in (("ANNUAL", str), ("AR6", lambda y: f"{y - 9}-{y}")):
        got = {(r.end_step, r.label): r.value for r in run.historical(spark, out, definition).filter("variable = 'Tot' and percentile = 50").collect()}
        assert got == {(y, label(y)): of(y, label(y)) for y in (1887, 1888, 1889)}
    assert {r.end_step: r.value for r in run.constrained(spark, out).filter("variable = 'Tot' and percentile = 50").collect()} == {y: of(y, "1889") for y in (1887, 1888, 1889)}
    new, revised = (({r.end_step: r.value for r in df.filter("variable = 'Tot' and percentile = 50").collect()}) for df in run.revisions(spark, out))
    assert new == {y: of(y, str(y)) - of(y, str(y - 1)) for y in (1887, 1888, 1889)}
    assert revised == {y: of(y, str(y - 1)) - of(y - 1, str(y - 1)) for y in (1888, 1889)}
    full = {(r.definition, r.t): (r.value, r.less_measured) for r in run.full_information(spark, out, temperature).filter("variable = 'Tot'").collect()}
    assert full["ANNUAL", 1889] == (of(1889, "1889"), None) and math.isclose(full["AR6", 1889][0], np.mean([of(1889, str(y)) for y in range(1880, 1890)]))
    assert math.isclose(full["CGWL", 1870][1], np.mean([of(1889, str(y)) - measured[y - 1850] for y in range(1860, 1880)]), abs_tol=1e-12)
