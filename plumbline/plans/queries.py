"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import attribution as at
from ..operators import products, response, summary, sumset
from ..operators import regression as reg
from ..operators import timeseries as ts
from ..sources import files, forcing
from ..sources import standins as src
from ..sources.stored import shared_path, stored
from . import config
from .oracle import quantiles, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
V = at.VARIABLES


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = sql(oracle)
        return f

    return add


def r(c, out: str | None = None):
    """Rounded to 6 places, never minus zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(out or c)


def n(c, out: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(out or c)


# -- sources


@query("src_dispatch_filter", "SELECT variable, ensemble, t, round(value, 6) + 0.0 AS value FROM forcing WHERE variable IN ('GHG', 'Nat') AND ensemble = 'ens1'")
def _(s, d):
    return src.forcing(s, d).filter(F.col("variable").isin("GHG", "Nat") & (F.col("ensemble") == "ens1")).select("variable", "ensemble", "t", r("value"))


@query("src_ens_prefix", "SELECT 'ens' || l_linenumber AS ensemble, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    return src.table(s, d, "lineitem").groupBy(F.concat(F.lit("ens"), F.col("l_linenumber").cast("string")).alias("ensemble")).agg(F.count("*").alias("n"))


@query("src_unpivot", "SELECT p_partkey, 'size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def _(s, d):
    at = shared_path(s, "wide")
    src.table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).write.csv(at, header=True)
    return files.read_wide_csv(s, at, "p_partkey", name="variable").select(n("t", "p_partkey"), "variable", "value")


@query("src_replicate_cross", "SELECT r_name AS ensemble, c_nationkey AS t, round(avg(c_acctbal), 4) AS value FROM customer, region GROUP BY 1, 2")
def _(s, d):
    series = src.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("t")).agg(F.round(F.avg("c_acctbal"), 4).alias("value"))
    members = src.table(s, d, "region").select(F.col("r_name").alias("ensemble"))
    return forcing.replicate(series.withColumn("ensemble", F.lit("single")), members).select("ensemble", "t", "value")


@query("src_ssp_select", """SELECT variable, t, round(value, 2) AS value FROM (
  SELECT CASE WHEN o_orderstatus = 'F' THEN 'GHG' ELSE 'OHF' END AS variable, CAST(floor(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0) AS BIGINT) AS t, sum(o_totalprice) AS value FROM orders WHERE lower(o_orderpriority) = '1-urgent' GROUP BY 1, 2)""")  # fmt: skip
def _(s, d):
    kind = F.when(F.col("o_orderstatus") == "F", F.lit("ghg")).when(F.col("o_orderstatus") == "O", F.lit("aerosol")).otherwise(F.lit("other"))
    year = F.floor(F.year("o_orderdate") + (F.month("o_orderdate") - 1) / 12) + 0.5
    raw = src.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("scenario"), kind.alias("variable"), F.lit("single").alias("ensemble"), year.alias("year")).agg(F.sum("o_totalprice").alias("value"))
    return forcing.ssp(raw, "1-Urgent").select("variable", n("t"), F.round("value", 2).alias("value"))


@query("obs_baseline", "SELECT member, t, round(value, 6) + 0.0 AS value FROM obsb")
def _(s, d):
    return src.obs_baseline(s, d).select("member", "t", r("value"))


@query("src_regex_columns", "SELECT 'p_retailprice' AS name, count(p_retailprice) AS n, round(sum(p_retailprice), 2) AS total FROM part UNION ALL SELECT 'p_size', count(p_size), CAST(sum(p_size) AS DOUBLE) FROM part")
def _(s, d):
    p = src.table(s, d, "part").select("p_name", "p_size", "p_retailprice")
    chosen = p.select(p.colRegex("`p_(size|retail.*)`"))
    doubles = chosen.select(*(F.col(c).cast("double") for c in chosen.columns))
    return doubles.unpivot([], doubles.columns, "name", "value").groupBy("name").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("ctl_path_metadata", """SELECT page_id, string_split(url, '/')[1] AS scheme, string_split(url, '/')[3] AS model, string_split(string_split(url, '/')[5], '?')[1] AS member,
  string_split(url, '/')[4] || '_' || string_split(url, '/')[3] AS name FROM pages""")
def _(s, d):
    parts = F.split("url", "/")
    part = lambda i: F.element_at(parts, i)
    return src.table(s, d, "pages").select("page_id", part(1).alias("scheme"), part(3).alias("model"), F.element_at(F.split(part(5), r"\?"), 1).alias("member"), F.concat_ws("_", part(4), part(3)).alias("name"))


@query("src_params_long", "SELECT model, box, round(d, 6) AS d, round(q, 6) AS q FROM params")
def _(s, d):
    return src.model_params(s, d).select("model", "box", r("d"), r("q"))


@query("sink_roundtrip", "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", "forcing") + ")")
def _(s, d):
    got = summary.percentiles(src.forcing(s, d), ["t", "variable"])
    at = shared_path(s, "results")
    files.write_result_csv(got.select(F.col("t").cast("string").alias("label"), "variable", "percentile", "value"), at)
    return files.read_result_csv(s, at).select(n("label", "t"), "variable", "percentile", r("value"))


@query("catalog_distinct", "SELECT DISTINCT lang AS scenario, source AS member FROM documents")
def _(s, d):
    at, keys = shared_path(s, "catalogue"), ["scenario", "member"]
    runs = src.table(s, d, "documents").groupBy(F.col("lang").alias("scenario"), F.col("source").alias("member")).agg(F.count("*").alias("n"))
    files.write_results(runs, at, keys)
    return files.catalog(s, at, keys)


# -- projections, filters, reshapes


@query("proj_variables", "SELECT variable, ensemble, t, round(value, 6) + 0.0 AS value FROM forcing WHERE variable IN ('Nat', 'OHF')")
def _(s, d):
    return src.forcing(s, d).filter(F.col("variable").isin("Nat", "OHF")).select("variable", "ensemble", "t", r("value"))


@query("filter_member", "SELECT member, t, round(value, 6) + 0.0 AS value FROM obs WHERE member = '2-HIGH'")
def _(s, d):
    return src.measurements(s, d).filter(F.col("member") == "2-HIGH").select("member", "t", r("value"))


@query("filter_year_range", "SELECT variable, ensemble, t, round(value, 6) + 0.0 AS value FROM forcing WHERE t BETWEEN 4 AND 11")
def _(s, d):
    return src.forcing(s, d).filter(F.col("t").between(4, 11)).select("variable", "ensemble", "t", r("value"))


@query("proj_rename", "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders")
def _(s, d):
    return src.table(s, d, "orders").withColumnsRenamed({"o_orderkey": "key", "o_orderstatus": "status", "o_totalprice": "price"}).drop("o_custkey", "o_orderdate", "o_orderpriority")


@query("reshape_pivot", "SELECT t, round(max(value) FILTER (member = '1-URGENT'), 6) AS urgent, round(max(value) FILTER (member = '2-HIGH'), 6) AS high, round(max(value) FILTER (member = '5-LOW'), 6) AS low FROM obs GROUP BY t")
def _(s, d):
    w = src.measurements(s, d).groupBy("t").pivot("member", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.first("value"))
    return w.select("t", r("1-URGENT", "urgent"), r("2-HIGH", "high"), r("5-LOW", "low"))


@query("reshape_unpivot", "SELECT c_custkey, name, value FROM (SELECT c_custkey, 'balance' AS name, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS DOUBLE) FROM customer)")
def _(s, d):
    c = src.table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return c.unpivot("c_custkey", ["balance", "nation"], "name", "value")


@query("proj_const_column", "SELECT t, member, round(value, 6) AS value, CAST(1 AS DOUBLE) AS const, 'single' AS ensemble FROM obs")
def _(s, d):
    return src.measurements(s, d).select("t", "member", r("value"), F.lit(1.0).alias("const"), F.lit("single").alias("ensemble"))


_DROPPED = "SELECT event_id, value FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) WHERE value IS NOT NULL"


@query("filter_dropna", _DROPPED)
def _(s, d):
    return src.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")).na.drop(subset=["value"])


@query("filter_cross_section", "SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def _(s, d):
    world = src.table(s, d, "region").filter(F.col("r_name") == "ASIA")
    return src.table(s, d, "nation").join(F.broadcast(world), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")


@query("ctl_filter", "SELECT member, slice_start FROM kept")
def _(s, d):
    return src.control_kept(s, d)


@query("hist_drop_zero", "SELECT t, round(min(v), 6) AS lo, round(max(v), 6) AS hi FROM (SELECT t, CASE WHEN t % 4 = 0 THEN 0 ELSE value END AS v FROM obs) GROUP BY t HAVING max(CASE WHEN v <> 0 THEN 1 ELSE 0 END) = 1")
def _(s, d):
    o = src.measurements(s, d).withColumn("v", F.when(F.col("t") % 4 == 0, 0.0).otherwise(F.col("value")))
    return o.groupBy("t").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.col("v") != 0).alias("any")).filter("any").select("t", r("lo"), r("hi"))


def _run(s, d, variables=V):
    """Wide responses, coefficients, pairs and measurements of the stand-in run: every member with every slice of control noise."""
    resp, obs = stored(src.responses(s, d)), src.obs_baseline(s, d)
    wide = stored(_regressors(at.wide(resp, V), variables))
    coef = stored(at.coefficients(wide, obs, src.control_targets(s, d), variables, *src.REGRESS))
    return wide, coef, at.paired(coef, variables), obs


def _regressors(wide, variables):
    """The regressed variables, summed from GHG, Nat and OHF where they are sums."""
    made = {"Ant": F.col("GHG") + F.col("OHF"), "Tot": F.col("GHG") + F.col("Nat") + F.col("OHF")}
    return wide.select("model", "ensemble", "t", *(made.get(v, F.col(v)).alias(v) for v in variables))


def _lines(s, d, variables=V, least=None):
    """Wide responses, measurements and what ``at.linear`` takes the pairs of the stand-in run from, or with ``least`` those of its growing runs.

    The targets themselves wherever every one has every step; their coefficients else.
    """
    wide, obs, ctl = stored(_regressors(at.wide(stored(src.responses(s, d)), V), variables)), stored(src.obs_baseline(s, d)), src.control_series(s, d)
    both = at.series(wide, obs, ctl, variables, *src.REGRESS, least) if ctl is not None else None
    if both is None and least is None:
        both = at.met(stored(at.coefficients(wide, obs, src.control_targets(s, d), variables, *src.REGRESS)), variables)
    elif both is None:
        both = at.met(stored(at.growing_coefficients(wide, obs, src.control_targets(s, d), variables, src.REGRESS[0], least, src.REGRESS[1])), variables, ["end_step"])
    return wide, obs, both


_OBS = ["model", "ensemble", "obs"]


def _over_controls(df, keys, columns):
    """Number, bounds and mean over the control members; ``columns`` maps names to columns."""
    of = lambda f, c: (F.round(f(c), 4) + 0.0)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(of(f, c).alias(f"{name}_{end}") for name, c in columns.items() for f, end in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))))


def _over_controls_sql(keys: str, source: str, **columns: str) -> str:
    of = ", ".join(f"round({f}({c}), 4) + 0.0 AS {name}_{end}" for name, c in columns.items() for f, end in (("min", "lo"), ("max", "hi"), ("avg", "mean")))
    return f"SELECT {keys}, count(*) AS n, {of} FROM {source} GROUP BY {keys}"


@query("filter_coef_mask", _over_controls_sql("model, ensemble, obs", "(SELECT * FROM pairs WHERE NOT (bg <= 0 AND bo <= 0))", b_ghg="bg", b_ohf="bo"))
def _(s, d):
    p = _run(s, d)[2].filter(~F.forall(F.array("b_GHG", "b_OHF"), lambda b: b <= 0))
    return _over_controls(p, _OBS, {"b_ghg": "b_GHG", "b_ohf": "b_OHF"})


@query("distinct_sorted", "SELECT DISTINCT variable FROM forcing ORDER BY variable")
def _(s, d):
    return src.forcing(s, d).select("variable").distinct().orderBy("variable")


@query("pred_suite", """SELECT page_id, regexp_matches(url, '/[0-9]+') AS numbered, url LIKE '%.html' AS html, contains(url, 'utm_source') AS tracked, length(url) BETWEEN 30 AND 50 AS mid,
  string_split(url, ':')[1] IN ('http', 'ftp') AS plain, regexp_matches(string_split(url, '/')[5], '^[0-9]+$') AS numeric FROM pages""")
def _(s, d):
    u = F.col("url")
    return src.table(s, d, "pages").select(
        "page_id", u.rlike("/[0-9]+").alias("numbered"), u.endswith(".html").alias("html"), u.contains("utm_source").alias("tracked"), F.length(u).between(30, 50).alias("mid"),
        F.split(u, ":")[0].isin("http", "ftp").alias("plain"), labels.numeric(F.element_at(F.split(u, "/"), 5)).alias("numeric"),
    )


# -- joins


@query("join_coef_cross", _over_controls_sql("model, ensemble, obs", "pairs", b_ghg="bg", b_nat="bn", b_ohf="bo", b_const="b0"))
def _(s, d):
    return _over_controls(_run(s, d)[2], _OBS, {"b_ghg": "b_GHG", "b_nat": "b_Nat", "b_ohf": "b_OHF", "b_const": "b_const"})


@query("join_bucketed", "SELECT model, ensemble, t, count(*) AS n, round(min(Tot), 4) + 0.0 AS lo, round(max(Tot), 4) + 0.0 AS hi, round(avg(Tot), 4) + 0.0 AS mean FROM att GROUP BY model, ensemble, t")
def _(s, d):
    """Responses and coefficients from tables laid out alike, so that every pair's total is found without an exchange."""
    wide, coef, _, _ = _run(s, d)
    sides = at.sides(coef, V, bucket=True)
    # One row for each response member, so that a block of coefficients is read once for all its steps.
    points = at.linear(wide, None, V).over(lambda p: p.filter("variable = 'Tot'").select("*", F.col("model").alias("of_model"), F.col("ensemble").alias("of_ensemble")))
    laid = sides.laid(sumset.grouped(points, ["of_model", "of_ensemble", "t"]))[0]
    both = laid.join(sides.obs.hint("merge"), sides.at).join(sides.ctl.hint("merge"), sides.at).select("points", "obs", "ctl")
    each = sumset.bounds(both, {"of_model": "string", "of_ensemble": "string", "t": "long"})
    of = lambda c, out: (F.round(c, 4) + 0.0).alias(out)
    return each.select(F.col("of_model").alias("model"), F.col("of_ensemble").alias("ensemble"), "t", "n", of(F.col("lo"), "lo"), of(F.col("hi"), "hi"), of(F.col("total") / F.col("n"), "mean"))


@query("join_year_equi", "SELECT ensemble, variable, member, t, round(f.value, 6) AS x, round(o.value, 6) AS y FROM forcing f JOIN obs o USING (t) WHERE ensemble = 'ens2'")
def _(s, d):
    f = src.forcing(s, d).filter(F.col("ensemble") == "ens2").select("ensemble", "variable", "t", r("value", "x"))
    return f.join(src.measurements(s, d).select("member", "t", r("value", "y")), "t").select("ensemble", "variable", "member", "t", "x", "y")


@query("join_full_outer", "SELECT t, round(a.value, 6) AS a, round(b.value, 6) AS b FROM (SELECT * FROM forcing WHERE variable = 'GHG' AND ensemble = 'ens1' AND t >= 3) a FULL JOIN (SELECT * FROM obs WHERE member = '1-URGENT') b USING (t)")
def _(s, d):
    a = src.forcing(s, d).filter((F.col("variable") == "GHG") & (F.col("ensemble") == "ens1") & (F.col("t") >= 3)).select("t", r("value", "a"))
    return a.join(src.measurements(s, d).filter(F.col("member") == "1-URGENT").select("t", r("value", "b")), "t", "full_outer")


@query("join_align_arith", "SELECT t, variable, round(a.value + b.value, 6) AS value FROM (SELECT * FROM forcing WHERE ensemble = 'ens1' AND t < 20) a FULL JOIN (SELECT * FROM forcing WHERE ensemble = 'ens2' AND t > 5) b USING (t, variable)")
def _(s, d):
    f = src.forcing(s, d)
    a = f.filter((F.col("ensemble") == "ens1") & (F.col("t") < 20)).select("t", "variable", F.col("value").alias("a"))
    b = f.filter((F.col("ensemble") == "ens2") & (F.col("t") > 5)).select("t", "variable", F.col("value").alias("b"))
    return a.join(b, ["t", "variable"], "full_outer").select("t", "variable", r(F.col("a") + F.col("b"), "value"))


def _shown(s, d, obs: bool = False, variables=V):
    wide, _, pairs, measured = _run(s, d, variables)
    return at.attributed(wide, pairs, variables, measured if obs else None)


_MEMBER = [*_OBS, "t"]
_MEMBERS = "model, ensemble, obs, t"


@query("attrib_components", _over_controls_sql(_MEMBERS, "att", ghg="GHG", nat="Nat", ohf="OHF"))
def _(s, d):
    return _over_controls(_shown(s, d), _MEMBER, {v.lower(): v for v in V})


@query("attrib_ant", _over_controls_sql(_MEMBERS, "att", ant="Ant"))
def _(s, d):
    return _over_controls(_shown(s, d), _MEMBER, {"ant": "Ant"})


@query("attrib_total", _over_controls_sql(_MEMBERS, "att", tot="Tot"))
def _(s, d):
    return _over_controls(_shown(s, d), _MEMBER, {"tot": "Tot"})


@query("attrib_residual", _over_controls_sql(_MEMBERS, "(SELECT * FROM att WHERE Res IS NOT NULL)", res="Res"))
def _(s, d):
    return _over_controls(_shown(s, d, obs=True).filter("Res is not null"), _MEMBER, {"res": "Res"})


def _sums(s, d, obs: bool = False, variables=V, at_steps=None):
    """model, ensemble, t, variable and the two sides of every pair's value; of all steps, or those that ``at_steps`` keeps."""
    wide, measured, both = _lines(s, d, variables)
    return at.linear(wide if at_steps is None else at_steps(wide), both, variables, measured if obs else None)


@query("attrib_1var", "SELECT t, percentile, round(value, 5) + 0.0 AS tot FROM (" + quantiles("t", "att1", "Tot") + ")")
def _(s, d):
    return sumset.percentiles(_sums(s, d, variables=["Tot"]), ["t"]).select("t", "percentile", (F.round("value", 5) + 0.0).alias("tot"))


@query("attrib_2var", "SELECT t, variable, percentile, round(value, 5) + 0.0 AS value FROM (" + quantiles("t, variable", "att2long") + ")")
def _(s, d):
    return sumset.percentiles(_sums(s, d, variables=["Ant", "Nat"]), ["t", "variable"]).select("t", "variable", "percentile", (F.round("value", 5) + 0.0).alias("value"))


@query("join_range_window", "SELECT h, member, round(avg(value), 6) AS value, count(*) AS n FROM obs, (SELECT DISTINCT t AS h FROM obs WHERE t >= 9) WHERE t BETWEEN h - 9 AND h GROUP BY 1, 2")
def _(s, d):
    o = src.measurements(s, d)
    # A row is in the windows that end at its own step or the nine after it: equal keys in place of a range.
    ends = o.select(F.col("t").alias("h")).distinct().filter("h >= 9")
    each = o.withColumn("h", F.explode(F.sequence("t", F.col("t") + 9)))
    return each.join(ends, "h", "left_semi").groupBy("h", "member").agg(r(F.avg("value"), "value"), F.count("*").alias("n"))


@query("conv_theta_join", "SELECT g.variable, g.ensemble, g.t, round(sum(f.value * exp(-(g.t - f.t) / 4.0)), 6) AS value FROM forcing f JOIN forcing g ON f.variable = g.variable AND f.ensemble = g.ensemble AND f.t <= g.t GROUP BY 1, 2, 3")
def _(s, d):
    return response.convolve(src.forcing(s, d), ["variable", "ensemble"], [(1.0, math.exp(-1 / 4))]).select("variable", "ensemble", "t", r("value"))


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(s, d):
    o = src.table(s, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    c = src.table(s, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("join_anti", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def _(s, d):
    li = src.table(s, d, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    p = src.table(s, d, "part")
    return p.join(li, p.p_partkey == li.l_partkey, "left_anti").select("p_partkey", "p_brand")


# -- reductions


@query("agg_percentiles", "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", "resp") + ")")
def _(s, d):
    return summary.percentiles(src.responses(s, d), ["t", "variable"]).select("t", "variable", "percentile", r("value"))


@query("agg_median_by_year", "SELECT t, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS q95 FROM obs GROUP BY t")
def _(s, d):
    return src.measurements(s, d).groupBy("t").agg(r(F.percentile("value", F.lit(0.5)), "median"), r(F.percentile("value", F.lit(0.95)), "q95"))


@query("resp_baseline", "SELECT model, ensemble, variable, t, round(value, 6) + 0.0 AS value FROM resp")
def _(s, d):
    return src.responses(s, d).select("model", "ensemble", "variable", "t", r("value"))


@query("agg_sum_vars", "SELECT ensemble, t, round(sum(value), 6) AS ant FROM forcing WHERE variable IN ('GHG', 'OHF') GROUP BY 1, 2")
def _(s, d):
    return src.forcing(s, d).filter(F.col("variable").isin("GHG", "OHF")).groupBy("ensemble", "t").agg(r(F.sum("value"), "ant"))


@query("agg_weighted_mean", "SELECT t, variable, percentile, CASE WHEN count(*) = 3 THEN round(sum(value * weight) / sum(weight), 6) + 0.0 END AS value FROM repeats GROUP BY 1, 2, 3")
def _(s, d):
    chosen = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("repeat_id")
    rows = _sums(s, d).over(lambda p: p.select("*", F.substring("ensemble", 4, 9).cast("int").alias("e"), chosen).filter((F.col("e") % 3 < F.col("repeat_id")) & ~((F.col("repeat_id") == 2) & (F.col("t") == 0))))
    sized = sumset.percentiles(rows, ["repeat_id", "t", "variable"], size="weight")
    return summary.weighted_mean(sized, ["t", "variable", "percentile"], 3).select("t", "variable", "percentile", r("value"))


@query("agg_rms", "SELECT variable, round(sqrt(avg(value * value)), 6) AS rms, round(sqrt(avg(value * value)) / max(abs(value)), 6) AS ratio FROM resp GROUP BY 1")
def _(s, d):
    return src.responses(s, d).groupBy("variable").agg(r(summary.rms(), "rms"), r(summary.rms() / F.max(F.abs("value")), "ratio"))


@query("agg_ensemble_size", "SELECT (SELECT count(DISTINCT ensemble) FROM forcing) AS forcings, (SELECT count(DISTINCT member) FROM obs) AS measured, (SELECT count(DISTINCT member) FROM ctl) AS controls, (SELECT count(DISTINCT model) FROM params) AS models, (SELECT count(DISTINCT ensemble) FROM forcing) * (SELECT count(DISTINCT member) FROM obs) * (SELECT count(DISTINCT member) FROM ctl) * (SELECT count(DISTINCT model) FROM params) AS size")
def _(s, d):
    count = lambda df, c, out: F.broadcast(df.agg(F.countDistinct(c).alias(out)))
    one = count(src.forcing(s, d), "ensemble", "forcings").crossJoin(count(src.measurements(s, d), "member", "measured")).crossJoin(count(src.control_targets(s, d), "member", "controls")).crossJoin(count(src.model_params(s, d), "model", "models"))
    return one.withColumn("size", F.col("forcings") * F.col("measured") * F.col("controls") * F.col("models"))


@query("agg_bounds", "SELECT variable, min(t) AS first, max(t) AS last, min(ensemble) AS lowest, max(ensemble) AS highest FROM forcing GROUP BY 1")
def _(s, d):
    return src.forcing(s, d).groupBy("variable").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.min("ensemble").alias("lowest"), F.max("ensemble").alias("highest"))


@query("check_ensemble_sets", "SELECT count(DISTINCT es) = 1 AS same, max(n) AS n FROM (SELECT variable, string_agg(DISTINCT ensemble, ',' ORDER BY ensemble) AS es, count(DISTINCT ensemble) AS n FROM forcing GROUP BY 1)")
def _(s, d):
    sets = src.forcing(s, d).groupBy("variable").agg(F.array_sort(F.collect_set("ensemble")).alias("es"))
    return sets.agg((F.countDistinct("es") == 1).alias("same"), n(F.max(F.size("es")), "n"))


@query("check_steps", "SELECT variable, ensemble, bool_and(coalesce(t - p = 1, true)) AS ok FROM (SELECT variable, ensemble, t, lag(t) OVER (PARTITION BY variable, ensemble ORDER BY t) AS p FROM (SELECT DISTINCT variable, ensemble, t FROM forcing WHERE NOT (variable = 'Nat' AND t = 7))) GROUP BY 1, 2")
def _(s, d):
    return ts.is_contiguous(src.forcing(s, d).filter(~((F.col("variable") == "Nat") & (F.col("t") == 7))), ["variable", "ensemble"])


# -- regression


@query("regress_3var", "SELECT model, ensemble, kind, target, round(bg, 4) + 0.0 AS b_ghg, round(bn, 4) + 0.0 AS b_nat, round(bo, 4) + 0.0 AS b_ohf, round(b0, 4) + 0.0 AS b_const FROM coef")
def _(s, d):
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c.lower())
    return _run(s, d)[1].select("model", "ensemble", "kind", "target", r4("b_GHG"), r4("b_Nat"), r4("b_OHF"), r4("b_const"))


def _on(s, d, columns):
    w = at.wide(src.responses(s, d), V).withColumns(columns)
    return w.join(src.obs_baseline(s, d).select("member", "t", F.col("value").alias("y")), "t").filter(F.col("t").between(*src.REGRESS))


@query("regress_1var", "SELECT model, ensemble, member, round(regr_slope(y, x), 6) + 0.0 AS b_tot, round(regr_intercept(y, x), 6) + 0.0 AS b_const FROM (SELECT model, ensemble, member, g + n + o AS x, obsb.value AS y FROM wide JOIN obsb USING (t) WHERE t BETWEEN 0 AND 26) GROUP BY 1, 2, 3")
def _(s, d):
    rows = _on(s, d, {"Tot": F.col("GHG") + F.col("Nat") + F.col("OHF")})
    return reg.ols(rows, ["model", "ensemble", "member"], ["Tot"]).select("model", "ensemble", "member", r("b_Tot", "b_tot"), r("b_const"))


@query("regress_2var", """SELECT model, ensemble, member, round(ba, 6) + 0.0 AS b_ant, round(bn, 6) + 0.0 AS b_nat, round(my - ba * ma - bn * mn, 6) + 0.0 AS b_const FROM (
  SELECT *, (ay * nn - an * ny) / (aa * nn - an * an) AS ba, (aa * ny - an * ay) / (aa * nn - an * an) AS bn FROM (
  SELECT model, ensemble, member, covar_pop(a, a) AS aa, covar_pop(a, n) AS an, covar_pop(n, n) AS nn, covar_pop(a, y) AS ay, covar_pop(n, y) AS ny, avg(a) AS ma, avg(n) AS mn, avg(y) AS my
  FROM (SELECT model, ensemble, member, g + o AS a, n, obsb.value AS y FROM wide JOIN obsb USING (t) WHERE t BETWEEN 0 AND 26) GROUP BY 1, 2, 3))""")
def _(s, d):
    rows = _on(s, d, {"Ant": F.col("GHG") + F.col("OHF")})
    return reg.ols(rows, ["model", "ensemble", "member"], ["Ant", "Nat"]).select("model", "ensemble", "member", r("b_Ant", "b_ant"), r("b_Nat", "b_nat"), r("b_const"))


@query("regress_tall", """SELECT l_returnflag, n, round(bq, 4) + 0.0 AS b_quantity, round(bd, 3) + 0.0 AS b_discount, round(my - bq * mq - bd * md, 3) + 0.0 AS b_const FROM (
  SELECT *, (qy * dd - qd * dy) / (qq * dd - qd * qd) AS bq, (qq * dy - qd * qy) / (qq * dd - qd * qd) AS bd FROM (
  SELECT l_returnflag, count(*) AS n, covar_pop(q, q) AS qq, covar_pop(q, d) AS qd, covar_pop(d, d) AS dd, covar_pop(q, y) AS qy, covar_pop(d, y) AS dy, avg(q) AS mq, avg(d) AS md, avg(y) AS my
  FROM (SELECT l_returnflag, l_quantity AS q, l_discount AS d, l_extendedprice AS y FROM lineitem) GROUP BY 1))""")
def _(s, d):
    """Three keys that hold all rows."""
    rows = src.table(s, d, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_extendedprice")
    counts = rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))
    found = reg.lstsq(rows, ["l_returnflag"], ["l_quantity", "l_discount"], "l_extendedprice").join(counts, "l_returnflag")
    return found.select("l_returnflag", "n", (F.round("b_l_quantity", 4) + 0.0).alias("b_quantity"), (F.round("b_l_discount", 3) + 0.0).alias("b_discount"), (F.round("b_const", 3) + 0.0).alias("b_const"))


@query("kde_grid", """SELECT event_type, i, round(x, 6) AS x, round(avg(exp(-power((x - value) / h, 2) / 2) / h) / sqrt(2 * pi()), 6) AS density FROM (
  SELECT event_type, i, lo + (hi - lo) * i / 24 AS x, h FROM (SELECT event_type, min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(value), -0.2) AS h FROM daily GROUP BY 1), (SELECT unnest(range(25)) AS i)) g JOIN daily USING (event_type) GROUP BY 1, 2, x""".replace("daily", "(SELECT event_type, CAST(ts AS DATE) AS t, avg(value) AS value FROM events GROUP BY 1, 2)"))  # fmt: skip
def _(s, d):
    daily = src.table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("t")).agg(F.avg("value").alias("value"))
    return summary.kde(daily, ["event_type"], 25).select("event_type", n("i"), r("x"), r("density"))


# -- windows

_KEYS = ["variable", "ensemble"]
_PART = "(PARTITION BY variable, ensemble ORDER BY t ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"


def _full(before, after, value="value"):
    w = _PART.format(before, after)
    return f"CASE WHEN count({value}) OVER {w} = {before + after + 1} THEN avg({value}) OVER {w} END"


@query("win_moving_average", f"SELECT variable, ensemble, t, round(ma, 6) AS ma FROM (SELECT variable, ensemble, t, {_full(2, 0)} AS ma FROM forcing) WHERE ma IS NOT NULL")
def _(s, d):
    return ts.moving_average(src.forcing(s, d), _KEYS, 3).select(*_KEYS, "t", r("ma"))


@query("win_rolling_lagged", f"SELECT variable, ensemble, t, round({_full(9, 0)}, 6) AS mean FROM forcing")
def _(s, d):
    return ts.rolling_mean(src.forcing(s, d), _KEYS, 9, 0, "mean").select(*_KEYS, "t", r("mean"))


@query("win_rolling_centered", f"SELECT variable, ensemble, t, round({_full(10, 9)}, 6) AS mean20, round({_full(4, 3)}, 6) AS mean8 FROM forcing")
def _(s, d):
    return ts.centred_mean(ts.centred_mean(src.forcing(s, d), _KEYS, 20, "mean20"), _KEYS, 8, "mean8").select(*_KEYS, "t", r("mean20"), r("mean8"))


@query("ctl_segments", "SELECT model, member, slice_start, t, round(value, 5) + 0.0 AS value FROM slices")
def _(s, d):
    return src.control_slices(s, d).select("model", "member", "slice_start", "t", (F.round("value", 5) + 0.0).alias("value"))


_SIGNAL = """SELECT variable, ensemble, t, round(signal, 6) + 0.0 AS signal FROM (SELECT variable, ensemble, t, {0} AS signal FROM (
  SELECT variable, ensemble, t, value FROM forcing
  UNION ALL SELECT variable, ensemble, lo - 1 - i, 0 FROM b, (SELECT unnest(range(2)) AS i)
  UNION ALL SELECT variable, ensemble, hi + 1 + i, slope * (hi + 1 + i) + level FROM b, (SELECT unnest(range(2)) AS i))) WHERE signal IS NOT NULL""".format(_full(2, 2))
_SIGNAL = _SIGNAL.replace("FROM b,", "FROM (SELECT variable, ensemble, min(t) AS lo, max(t) AS hi, regr_slope(value, t) FILTER (t > 22) AS slope, regr_intercept(value, t) FILTER (t > 22) AS level FROM forcing GROUP BY 1, 2),")


@query("win_temp_signal", _SIGNAL)
def _(s, d):
    return ts.signal(src.forcing(s, d), _KEYS, 5).select(*_KEYS, "t", r("signal"))


@query("obs_internal_var", """SELECT t, round(m - signal, 6) + 0.0 AS internal FROM (SELECT t, m, CASE WHEN count(*) OVER w = 5 THEN avg(m) OVER w END AS signal FROM (
  SELECT t, m FROM (SELECT t, quantile_cont(value, 0.5) AS m FROM obs GROUP BY t) UNION ALL SELECT -1 - i, 0 FROM (SELECT unnest(range(2)) AS i) UNION ALL SELECT 27 + i, 1.5 FROM (SELECT unnest(range(2)) AS i))
  WINDOW w AS (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE t BETWEEN 0 AND 26""")  # fmt: skip
def _(s, d):
    median = src.measurements(s, d).groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("value")).withColumn("series", F.lit("obs"))
    return median.join(ts.signal(median, ["series"], 5, "constant"), ["series", "t"]).select("t", r(F.col("value") - F.col("signal"), "internal"))


@query("trend_anchored", "SELECT member, t, round(value + b * (t - 26), 6) + 0.0 AS anchored FROM (SELECT member, regr_slope(value, t) AS b, max_by(value, t) AS value FROM obs WHERE t BETWEEN 12 AND 26 GROUP BY 1), (SELECT unnest(range(12, 27)) AS t)")
def _(s, d):
    o = src.measurements(s, d).filter(F.col("t").between(12, 26))
    line = o.groupBy("member").agg(F.regr_slope("value", "t").alias("b"), ts.last_value().alias("end"))
    return line.withColumn("t", F.explode(F.sequence(F.lit(12), F.lit(26)))).select("member", n("t"), r(F.col("end") + F.col("b") * (F.col("t") - 26), "anchored"))


# -- order, samples, sets


@query("sort_desc_drop", "SELECT member, t FROM (SELECT member, t, row_number() OVER (PARTITION BY member ORDER BY t) AS k FROM obs) WHERE k > 1 ORDER BY member, t DESC")
def _(s, d):
    k = F.row_number().over(Window.partitionBy("member").orderBy("t"))
    return src.measurements(s, d).select("member", "t").withColumn("k", k).filter("k > 1").drop("k").orderBy("member", F.desc("t"))


@query("sample_n", "SELECT o_orderkey FROM orders ORDER BY md5('7' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 60")
def _(s, d):
    return summary.sampled(src.table(s, d, "orders").select("o_orderkey"), "o_orderkey", 60, "7")


@query("limit_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def _(s, d):
    return src.table(s, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)


@query("last_value", "SELECT variable, ensemble, round(max_by(value, t), 6) AS last FROM forcing GROUP BY 1, 2")
def _(s, d):
    return src.forcing(s, d).groupBy(*_KEYS).agg(r(ts.last_value(), "last"))


@query("topk_years", "SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders ORDER BY y DESC LIMIT 4")
def _(s, d):
    return src.table(s, d, "orders").select(n(F.year("o_orderdate"), "y")).distinct().orderBy(F.desc("y")).limit(4)


@query("set_intersect", "SELECT o_custkey AS key FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def _(s, d):
    o = src.table(s, d, "orders")
    return o.filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("key")).intersect(o.filter(F.col("o_orderpriority") == "5-LOW").select("o_custkey"))


@query("set_except", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(s, d):
    return src.table(s, d, "customer").select(F.col("c_custkey").alias("key")).subtract(src.table(s, d, "orders").select("o_custkey"))


# -- scalar functions


@query("fn_string_suite", """SELECT page_id, string_split(url, '/')[3] AS host, replace(string_split(url, '/')[3], '.', '_') AS safe, lower(upper(url)) AS low, printf('%05d', page_id) AS padded,
  string_split(url, '/')[4] || '-' || string_split(url, '/')[3] AS joined, contains(url, 'example') AS has, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number FROM pages""")
def _(s, d):
    part = lambda i: F.element_at(F.split("url", "/"), i)
    return src.table(s, d, "pages").select(
        "page_id", part(3).alias("host"), F.replace(part(3), F.lit("."), F.lit("_")).alias("safe"), F.lower(F.upper("url")).alias("low"), F.format_string("%05d", "page_id").alias("padded"),
        F.concat_ws("-", part(4), part(3)).alias("joined"), F.col("url").contains("example").alias("has"), F.regexp_extract("url", "/([0-9]+)", 1).try_cast("long").alias("number"),
    )


@query("fn_math_suite", "SELECT event_id, round(exp(-value / 100), 6) AS e, round(sqrt(abs(value)), 6) AS s, round(power(value, 2), 4) AS p, ceil(value * 2) / 2 AS up, floor(value * 2) / 2 AS down, round_even(value, 1) AS even, event_id // 7 AS whole, event_id % 7 AS rest FROM events")
def _(s, d):
    v = F.col("value")
    return src.table(s, d, "events").select(
        "event_id", r(F.exp(-v / 100), "e"), r(F.sqrt(F.abs(v)), "s"), F.round(F.pow(v, F.lit(2)), 4).alias("p"), labels.half_up(v).alias("up"), (F.floor(v * 2) / 2).alias("down"),
        F.bround(v, 1).alias("even"), n(F.floor(F.col("event_id") / 7), "whole"), (F.col("event_id") % 7).alias("rest"),
    )


@query("fn_date_suite", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, strftime(o_orderdate, '%Y-%m') AS ym, CAST(floor(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0) AS BIGINT) AS whole, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def _(s, d):
    o = F.col("o_orderdate")
    return src.table(s, d, "orders").select("o_orderkey", n(F.year(o), "y"), n(F.quarter(o), "q"), F.date_format(o, "yyyy-MM").alias("ym"), n(F.floor(F.year(o) + (F.month(o) - 1) / 12), "whole"), n(F.date_diff(o, F.lit("1995-01-01").cast("date")), "days"))


@query("fn_label_dash", "SELECT DISTINCT translate(o_orderpriority, '-', '–') AS dashed, translate(translate(o_orderpriority, '-', '–'), '–', '-') AS plain FROM orders")
def _(s, d):
    dashed = labels.en_dash(F.col("o_orderpriority"))
    return src.table(s, d, "orders").select(dashed.alias("dashed"), labels.plain_dash(dashed).alias("plain")).distinct()


@query("fn_path_keys", "SELECT o_orderkey, 'VARIABLES--' || o_orderstatus || '_SIZE--' || CAST(o_custkey AS VARCHAR) || '.csv' AS name, o_orderstatus AS variables, o_custkey AS size FROM orders")
def _(s, d):
    name = F.concat(F.lit("VARIABLES--"), F.col("o_orderstatus"), F.lit("_SIZE--"), F.col("o_custkey").cast("string"), F.lit(".csv"))
    return src.table(s, d, "orders").select("o_orderkey", name.alias("name")).select("o_orderkey", "name", labels.path_value(F.col("name"), "VARIABLES").alias("variables"), F.split(labels.path_value(F.col("name"), "SIZE"), r"\.")[0].cast("long").alias("size"))


# -- headlines and rates: functionals of the responses first, then pairs, then percentiles

_SHOWN = [*V, "Ant", "Tot"]


def _headline(s, d, of, const: float = 1.0):
    """Percentiles by window end of a linear functional of the series; ``of`` maps (df, keys) to rows with t and value."""
    wide, _, both = _lines(s, d)
    reduced = of(at.long(wide, V, ["model", "ensemble", "t"]), ["model", "ensemble", "variable"]).select("model", "ensemble", "variable", "t", "value")
    return sumset.percentiles(at.linear(at.wide(reduced, V), both, V, const=const), ["t", "variable"])


def _headline_sql(of, const: int = 1) -> str:
    """``of`` gives the SQL of a functional of a column; it is linear, so it is taken of the responses, as in a test of every member."""
    per = f"SELECT model, ensemble, t, {of('g')} AS g, {of('n')} AS n, {of('o')} AS o FROM wide"
    att = f"SELECT t, bg * g AS GHG, bn * n AS Nat, bo * o AS OHF, bg * g + bo * o AS Ant, bg * g + bn * n + bo * o + {const} * b0 AS Tot FROM ({per}) JOIN pairs USING (model, ensemble) WHERE g IS NOT NULL"
    rows = f"(SELECT t, variable, value FROM (UNPIVOT ({att}) ON GHG, Nat, OHF, Ant, Tot INTO NAME variable VALUE value))"
    return "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", rows) + ")"


_W = "(PARTITION BY model, ensemble ORDER BY t ROWS BETWEEN {} PRECEDING AND {} FOLLOWING)"


def _mean_sql(before, after):
    w = _W.format(before, after)
    return lambda c: f"CASE WHEN count(*) OVER {w} = {before + after + 1} THEN avg({c}) OVER {w} END"


def _trend_sql(width, end: bool):
    w = _W.format(width - 1, 0)
    what = lambda c: f"regr_intercept({c}, t) OVER {w} + regr_slope({c}, t) OVER {w} * t" if end else f"regr_slope({c}, t) OVER {w}"
    return lambda c: f"CASE WHEN count(*) OVER {w} = {width} THEN {what(c)} END"


def _windowed(before, after):
    return lambda df, keys: ts.rolling_mean(df, keys, before, after, "mean").filter("mean is not null").withColumn("value", F.col("mean"))


def _out(df):
    return df.select("t", "variable", "percentile", r("value"))


@query("headline_annual", "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", "attlong") + ") WHERE t IN (SELECT max(t) FROM obs)")
def _(s, d):
    years = src.measurements(s, d).agg(F.max("t").alias("t"))
    return _out(sumset.percentiles(_sums(s, d, at_steps=lambda w: w.join(F.broadcast(years), "t")), ["t", "variable"]))


_NAMED_STEPS = config.headline_years("12, 19, 26", 26, 27)


@query("headline_years", f"SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM ({quantiles('t, variable', 'attlong')}) WHERE t IN ({', '.join(map(str, _NAMED_STEPS))})")
def _(s, d):
    """The headlines of a list of years."""
    return _out(sumset.percentiles(_sums(s, d, at_steps=lambda w: w.filter(F.col("t").isin(_NAMED_STEPS))), ["t", "variable"]))


@query("headline_ar6", _headline_sql(_mean_sql(9, 0)))
def _(s, d):
    return _out(_headline(s, d, _windowed(9, 0)))


@query("headline_cgwl", _headline_sql(_mean_sql(9, 10)))
def _(s, d):
    return _out(_headline(s, d, _windowed(9, 10)))


@query("headline_sr15", _headline_sql(_trend_sql(16, True)))
def _(s, d):
    return _out(_headline(s, d, lambda df, keys: ts.trend(df, keys, 16).withColumn("value", F.col("end"))))


@query("rate_ar6", _headline_sql(_trend_sql(10, False), const=0))
def _(s, d):
    return _out(_headline(s, d, lambda df, keys: ts.trend(df, keys, 10).withColumn("value", F.col("slope")), const=0.0))


_RATE = "(SELECT {0}, t, CASE WHEN count(*) OVER w = 10 THEN regr_slope(value, t) OVER w END AS value FROM {1} WINDOW w AS (PARTITION BY {0} ORDER BY t ROWS 9 PRECEDING))"


@query("rate_obs", "SELECT t, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t", _RATE.format("member", "obs")).replace(" GROUP BY ALL", " WHERE value IS NOT NULL GROUP BY ALL") + ")")
def _(s, d):
    return summary.percentiles(ts.trend(src.measurements(s, d), ["member"], 10), ["t"], "slope").select("t", "percentile", r("value"))


@query("rate_forcing", "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", _RATE.format("variable, ensemble", "(SELECT variable, ensemble, t, value FROM forcing UNION ALL SELECT 'Ant', ensemble, t, sum(value) FROM forcing WHERE variable <> 'Nat' GROUP BY 2, 3 UNION ALL SELECT 'Tot', ensemble, t, sum(value) FROM forcing GROUP BY 2, 3)")).replace(" GROUP BY ALL", " WHERE value IS NOT NULL GROUP BY ALL") + ")")
def _(s, d):
    f = src.forcing(s, d)
    both = f
    for name, part in (("Ant", f.filter("variable <> 'Nat'")), ("Tot", f)):
        both = both.unionByName(part.groupBy("ensemble", "t").agg(F.sum("value").alias("value")).withColumn("variable", F.lit(name)))
    return _out(summary.percentiles(ts.trend(both, _KEYS, 10), ["t", "variable"], "slope"))


@query("union_headlines", "SELECT 'ANNUAL' AS definition, member, t, round(value, 6) AS value FROM obs WHERE t = 26 UNION ALL SELECT 'AR6', member, 26, round(avg(value), 6) FROM obs WHERE t BETWEEN 17 AND 26 GROUP BY 2")
def _(s, d):
    o = src.measurements(s, d)
    annual = o.filter("t = 26").select(F.lit("ANNUAL").alias("definition"), "member", "t", r("value"))
    decade = o.filter(F.col("t").between(17, 26)).groupBy("member").agg(r(F.avg("value"), "value")).select(F.lit("AR6").alias("definition"), "member", F.lit(26).cast("long").alias("t"), "value")
    return annual.unionByName(decade)


@query("attrib_full", "SELECT t, variable, percentile, round(value, 6) + 0.0 AS value FROM (" + quantiles("t, variable", "(SELECT t, variable, value FROM attlong UNION ALL SELECT t, 'Res', Res FROM att WHERE Res IS NOT NULL)") + ")")
def attrib_full(s, d):
    return _out(sumset.percentiles(_sums(s, d, obs=True), ["t", "variable"]))


# -- responses


@query("box_response", "SELECT model, ensemble, variable, t, round(value, 6) AS value FROM respraw")
def _(s, d):
    return response.box_response(src.forcing(s, d), src.model_params(s, d)).select("model", "ensemble", "variable", "t", r("value"))


_GAS = {g: response.gas_params(g) for g in ("CO2", "CH4", "N2O")}


def _kernel_sql(kernel: str) -> str:
    return f"SELECT g.variable, g.ensemble, g.t, sum(f.value * ({kernel.replace('lag', '(g.t - f.t)')})) AS value FROM forcing f JOIN forcing g ON f.variable = g.variable AND f.ensemble = g.ensemble AND f.t <= g.t GROUP BY 1, 2, 3"


def _e(x):
    return f"{x!r}::DOUBLE"


def _ft(gas):
    return " + ".join(f"{_e(c / time)} * exp(-(lag + 0.5) / {_e(time)})" for c, time in gas.thermal)


def _ef(gas):
    held = lambda m: f"{_e(gas.concentration * gas.efficiency)} * ({_e(gas.lasting)} * ({m}) + " + " + ".join(f"{_e(part * time)} * (1 - exp(-({m}) / {_e(time)}))" for part, time in gas.decay) + ")"
    return f"{held('lag + 1')} - {held('lag')}"


def _et(gas):
    parts = []
    for c, slow in gas.thermal:
        parts.append(f"{_e(gas.lasting * c)} * (1 - exp(-(lag + 1) / {_e(slow)}))")
        parts += [f"{_e(part * time * c / (time - slow))} * (exp(-(lag + 1) / {_e(time)}) - exp(-(lag + 1) / {_e(slow)}))" for part, time in gas.decay]
    return f"{_e(gas.concentration * gas.efficiency)} * ({' + '.join(parts)})"


def _scaled(body):
    return f"SELECT variable, ensemble, t, round(value, 5) + 0.0 AS value FROM ({body})"


def _shown5(df):
    return df.select(*_KEYS, "t", (F.round("value", 5) + 0.0).alias("value"))


@query("ar5_ft", _scaled(_kernel_sql(_ft(_GAS["CO2"]))))
def _(s, d):
    return _shown5(response.forcing_to_temperature(src.forcing(s, d), _KEYS, _GAS["CO2"]))


@query("ar5_ef", _scaled(_kernel_sql(_ef(_GAS["CO2"]))))
def _(s, d):
    return _shown5(response.emissions_to_forcing(src.forcing(s, d), _KEYS, _GAS["CO2"]))


@query("ar5_et", _scaled(_kernel_sql(_et(_GAS["CO2"]))))
def _(s, d):
    return _shown5(response.emissions_to_temperature(src.forcing(s, d), _KEYS, _GAS["CO2"]))


@query("ar5_params", " UNION ALL ".join(f"SELECT '{g}' AS gas, variable, ensemble, round(max_by(value, t), 5) AS last FROM ({_kernel_sql(_ef(a))}) GROUP BY 2, 3" for g, a in _GAS.items()))
def _(s, d):
    f, out = src.forcing(s, d), None
    for g, a in _GAS.items():
        one = response.emissions_to_forcing(f, _KEYS, a).groupBy(*_KEYS).agg(F.round(ts.last_value(), 5).alias("last")).select(F.lit(g).alias("gas"), *_KEYS, "last")
        out = one if out is None else out.unionByName(one)
    return out


# -- products of growing runs: the full regression, with control noise, of every range from the first step

#: Rows of the shortest range.
LEAST = 16


def _runs(s, d):
    """end_step, t, variable, percentile, value of every run: its last two steps, and the last step of any."""
    wide, _, both = _lines(s, d, least=LEAST)
    ends = (both.weights if isinstance(both, at.Series) else both).select("end_step").distinct()
    last = ends.agg(F.max("end_step").alias("last"))
    wanted = ends.crossJoin(F.broadcast(last)).select("end_step", F.explode(F.array_distinct(F.array("last", "end_step", F.col("end_step") - 1))).alias("t"))
    return sumset.percentiles(at.linear(wide.join(F.broadcast(wanted), "t"), both, V, on=["end_step"]), ["end_step", "t", "variable"])


def _historical(s, d, definition, of, const: float = 1.0):
    """Each run's own headline: a functional of the responses at its last step, of the pairs of its own coefficients."""
    wide, _, both = _lines(s, d, least=LEAST)
    reduced = of(at.long(wide, V, ["model", "ensemble", "t"]), ["model", "ensemble", "variable"]).select("model", "ensemble", "variable", "t", "value")
    own = at.wide(reduced, V).withColumn("end_step", F.col("t"))
    found = sumset.percentiles(at.linear(own, both, V, const=const, on=["end_step"]), ["end_step", "variable"])
    named = found.withColumn("label", products.label(definition, F.col("end_step")))
    return products.historical_only(named, definition).select("end_step", "label", "variable", "percentile", (F.round("value", 4) + 0.0).alias("value"))


def _historical_sql(of, label: str, const: int = 1) -> str:
    per = f"SELECT model, ensemble, t AS end_step, {of('g')} AS g, {of('n')} AS n, {of('o')} AS o FROM wide"
    att = f"SELECT end_step, bg * g AS GHG, bn * n AS Nat, bo * o AS OHF, bg * g + bo * o AS Ant, bg * g + bn * n + bo * o + {const} * b0 AS Tot FROM ({per}) JOIN pairsg USING (model, ensemble, end_step) WHERE g IS NOT NULL"
    rows = f"(SELECT end_step, variable, value FROM (UNPIVOT ({att}) ON GHG, Nat, OHF, Ant, Tot INTO NAME variable VALUE value))"
    return f"SELECT end_step, {label} AS label, variable, percentile, round(value, 4) + 0.0 AS value FROM ({quantiles('end_step, variable', rows)})"


@query("hist_only", _historical_sql(_mean_sql(9, 0), "(end_step - 9) || '-' || end_step"))
def _(s, d):
    return _historical(s, d, "AR6", _windowed(9, 0))


@query("hist_only_annual", _historical_sql(lambda c: c, "CAST(end_step AS VARCHAR)"))
def _(s, d):
    return _historical(s, d, "ANNUAL", lambda df, keys: df)


@query("hist_only_sr15", _historical_sql(_trend_sql(16, True), "end_step || ' (SR15 definition)'"))
def _(s, d):
    return _historical(s, d, "SR15", lambda df, keys: ts.trend(df, keys, 16).withColumn("value", F.col("end")))


@query("hist_only_cgwl", _historical_sql(_mean_sql(9, 10), "(end_step - 9) || '-' || (end_step + 10) || ' (CGWL definition)'"))
def _(s, d):
    """Only runs that the responses outlast by ten steps have a row."""
    return _historical(s, d, "CGWL", _windowed(9, 10))


@query("hist_only_rate", _historical_sql(_trend_sql(10, False), "(end_step - 9) || '-' || end_step || ' (AR6 rate definition)'", 0))
def _(s, d):
    return _historical(s, d, "RATE", lambda df, keys: ts.trend(df, keys, 10).withColumn("value", F.col("slope")), 0.0)


@query("constrained", "SELECT end_step, variable, percentile, round(value, 4) + 0.0 AS value FROM runs WHERE t = (SELECT max(end_step) FROM runs)")
def _(s, d):
    return products.constrained(_runs(s, d)).select("end_step", "variable", "percentile", (F.round("value", 4) + 0.0).alias("value"))


@query("delta_new", "SELECT a.end_step, a.variable, a.percentile, round(a.value - b.value, 4) + 0.0 AS value FROM runs a JOIN runs b ON a.end_step = b.end_step AND a.variable = b.variable AND a.percentile = b.percentile AND a.t = a.end_step AND b.t = b.end_step - 1")
def _(s, d):
    return products.deltas(_runs(s, d))[0].select("end_step", "variable", "percentile", (F.round("value", 4) + 0.0).alias("value"))


@query("delta_revised", "SELECT a.end_step, a.variable, a.percentile, round(a.value - b.value, 4) + 0.0 AS value FROM runs a JOIN runs b ON b.end_step = a.end_step - 1 AND a.variable = b.variable AND a.percentile = b.percentile AND a.t = a.end_step - 1 AND b.t = b.end_step")
def _(s, d):
    return products.deltas(_runs(s, d))[1].select("end_step", "variable", "percentile", (F.round("value", 4) + 0.0).alias("value"))


@query("fullinfo_vs_obs", "SELECT t, round(l - c, 6) + 0.0 AS lagged_minus_centred FROM (SELECT t, CASE WHEN count(*) OVER a = 10 THEN avg(m) OVER a END AS l, CASE WHEN count(*) OVER b = 20 THEN avg(m) OVER b END AS c FROM (SELECT t, quantile_cont(value, 0.5) AS m FROM obs GROUP BY t) WINDOW a AS (ORDER BY t ROWS 9 PRECEDING), b AS (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) WHERE c IS NOT NULL AND l IS NOT NULL")
def _(s, d):
    m = src.measurements(s, d).groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("value")).withColumn("series", F.lit("obs"))
    both = ts.centred_mean(ts.rolling_mean(m, ["series"], 9, 0, "l"), ["series"], 20, "c").filter("l is not null and c is not null")
    return both.select("t", r(F.col("l") - F.col("c"), "lagged_minus_centred"))


_FULL = {"ANNUAL": (0, 0), "AR6": (9, 0), "SR15": (15, 14), "CGWL": (10, 9)}
_FULL_SQL = " UNION ALL ".join(f"SELECT '{k}' AS definition, variable, t, CASE WHEN count(*) OVER w = {a + b + 1} THEN avg(value) OVER w END AS value FROM med WINDOW w AS (PARTITION BY variable ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)" for k, (a, b) in _FULL.items())


@query("fullinfo_definitions", f"""SELECT definition, variable, t, round(x.value, 5) + 0.0 AS value, round(x.value - base, 5) + 0.0 AS less_measured FROM (
  WITH med AS (SELECT variable, t, quantile_cont(value, 0.5) AS value FROM attlong WHERE variable IN ('Ant', 'Nat', 'Tot') GROUP BY 1, 2) {_FULL_SQL}) x
  LEFT JOIN (SELECT t, CASE WHEN count(*) OVER w = 20 THEN avg(m) OVER w END AS base FROM (SELECT t, quantile_cont(value, 0.5) AS m FROM obsb GROUP BY t) WINDOW w AS (ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING)) USING (t)""")
def _(s, d):
    wide, obs, both = _lines(s, d)
    median = sumset.percentiles(at.linear(wide, both, V).over(lambda p: p.filter(F.col("variable").isin("Ant", "Nat", "Tot"))), ["t", "variable"], [50.0])
    measured = obs.groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("value"))
    r5 = lambda c: (F.round(c, 5) + 0.0).alias(c)
    return products.full_information(median, measured).select("definition", "variable", "t", r5("value"), r5("less_measured"))


# -- plot data


@query("plot_errorbars", "SELECT t, round_even(m, 2) AS centre, round(m - lo, 6) AS below, round(hi - m, 6) AS above, printf('%d: %.2f', t, round_even(m, 2)) AS label FROM (SELECT t, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM obs GROUP BY t)")
def _(s, d):
    p = src.measurements(s, d).groupBy("t").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95))).alias("p"))
    m = F.bround(F.col("p")[0], 2)
    return p.select("t", m.alias("centre"), r(F.col("p")[0] - F.col("p")[1], "below"), r(F.col("p")[2] - F.col("p")[0], "above"), F.format_string("%d: %.2f", "t", m).alias("label"))


@query("plot_bands", "SELECT variable, t, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi, round(avg(hi - lo) OVER (PARTITION BY variable), 6) AS mean_width, ceil(max(hi) OVER (PARTITION BY variable) * 2) / 2 AS top FROM (SELECT variable, t, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM resp GROUP BY 1, 2)")
def _(s, d):
    p = src.responses(s, d).groupBy("variable", "t").agg(F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p")).select("variable", "t", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    w = Window.partitionBy("variable")
    return p.select("variable", "t", r("lo"), r("hi"), r(F.avg(F.col("hi") - F.col("lo")).over(w), "mean_width"), labels.half_up(F.max("hi").over(w)).alias("top"))


@query("plot_residuals", "SELECT t, round(quantile_cont(Res, 0.05), 6) + 0.0 AS lo, round(quantile_cont(Res, 0.5), 6) + 0.0 AS mid, round(quantile_cont(Res, 0.95), 6) + 0.0 AS hi FROM att WHERE Res IS NOT NULL GROUP BY t")
def _(s, d):
    p = sumset.percentiles(_sums(s, d, obs=True).over(lambda p: p.filter("variable = 'Res'")), ["t"], [5.0, 50.0, 95.0])
    of = lambda q: F.max(F.when(F.col("percentile") == q, F.col("value")))
    return p.groupBy("t").agg(r(of(5.0), "lo"), r(of(50.0), "mid"), r(of(95.0), "hi"))


@query("plot_tot_vs_ant", _over_controls_sql(_MEMBERS, "att", ant="Ant", tot="Tot", natural="Tot - Ant"))
def _(s, d):
    return _over_controls(_shown(s, d), _MEMBER, {"ant": "Ant", "tot": "Tot", "natural": F.col("Tot") - F.col("Ant")})


@query("plot_pdf", """SELECT variable, i, round(x, 5) + 0.0 AS x, round(avg(exp(-power((x - value) / h, 2) / 2) / h) / sqrt(2 * pi()), 5) AS density FROM (
  SELECT variable, i, lo + (hi - lo) * i / 99 AS x, h FROM (SELECT variable, min(value) AS lo, max(value) AS hi, stddev_samp(value) * power(count(value), -0.2) AS h FROM attlong WHERE t = 26 GROUP BY 1), (SELECT unnest(range(100)) AS i)) g JOIN (SELECT * FROM attlong WHERE t = 26) USING (variable) GROUP BY 1, 2, x""")
def _(s, d):
    last = stored(at.long(_shown(s, d).filter("t = 26"), _SHOWN, ["t"]))
    return summary.kde(last, ["variable"], 100).select("variable", n("i"), (F.round("x", 5) + 0.0).alias("x"), F.round("density", 5).alias("density"))


#: Widths of the means that internal variability is shown by, and the limits of each density's grid.
_VARIABILITY = {1: 0.6, 3: 0.4, 9: 0.15}
_MEANS = " UNION ALL ".join(f"SELECT {w} AS width, member, t, CASE WHEN count(*) OVER w = {w} THEN avg(value) OVER w END AS value FROM variability WINDOW w AS (PARTITION BY member ORDER BY t ROWS {w - 1} PRECEDING)" for w in _VARIABILITY)
_MEANS = f"""WITH variability AS (SELECT member, t, value FROM ctl UNION ALL SELECT 'measured', t, m - signal FROM (SELECT t, m, avg(m) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS signal, count(*) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS k
  FROM (SELECT t, quantile_cont(value, 0.5) AS m FROM obs GROUP BY t)) WHERE k = 5) SELECT * FROM ({_MEANS}) WHERE value IS NOT NULL"""


def _variability(s, d):
    """width, member, t, value: moving means of every control slice, and of what is left of the measured median without its 5-step mean."""
    median = src.measurements(s, d).groupBy("t").agg(F.percentile("value", F.lit(0.5)).alias("value")).withColumn("member", F.lit("measured"))
    rest = ts.centred_mean(median, ["member"], 5, "signal").filter("signal is not null").select("member", "t", (F.col("value") - F.col("signal")).alias("value"))
    rows, each = stored(src.control_targets(s, d).unionByName(rest)), None
    for w in _VARIABILITY:
        one = ts.moving_average(rows, ["member"], w, "mean").select(F.lit(w).cast("long").alias("width"), "member", "t", F.col("mean").alias("value"))
        each = one if each is None else each.unionByName(one)
    return each


@query("plot_variability_means", f"SELECT width, member, count(*) AS n, min(t) AS first, max(t) AS last, round(min(value), 5) + 0.0 AS lo, round(max(value), 5) + 0.0 AS hi, round(sum(value * t), 4) + 0.0 AS by_step FROM ({_MEANS}) GROUP BY 1, 2")
def _(s, d):
    """The lines of the figure, each in short: its steps, bounds and sum by step."""
    f5 = lambda c, out, k=5: (F.round(c, k) + 0.0).alias(out)
    return _variability(s, d).groupBy("width", "member").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"), f5(F.min("value"), "lo"), f5(F.max("value"), "hi"), f5(F.sum(F.col("value") * F.col("t")), "by_step", 4))


@query("plot_variability_density", f"""SELECT width, CASE WHEN member = 'measured' THEN 'measured' ELSE 'control' END AS kind, i, round(min(density), 4) + 0.0 AS least, round(avg(density), 4) + 0.0 AS mean, round(max(density), 4) + 0.0 AS most FROM (
  SELECT width, member, i, avg(exp(-power((x - value) / h, 2) / 2) / h) / sqrt(2 * pi()) AS density FROM (
    SELECT width, member, h, i, CASE width WHEN 1 THEN 0.6 WHEN 3 THEN 0.4 ELSE 0.15 END * (2.0 * i / 49 - 1) AS x FROM (SELECT width, member, stddev_samp(value) * power(count(value), -0.2) AS h FROM means GROUP BY 1, 2) WHERE h > 0, (SELECT unnest(range(50)) AS i))
  JOIN means USING (width, member) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3""".replace("WHERE h > 0, (SELECT unnest(range(50)) AS i))", "CROSS JOIN (SELECT unnest(range(50)) AS i) WHERE h > 0)").replace("means GROUP BY 1, 2)", f"({_MEANS}) GROUP BY 1, 2)").replace("JOIN means", f"JOIN ({_MEANS})"))
def _(s, d):
    """Densities on 50 points of each width's own grid: of the measured series, and over the control slices."""
    rows, each = stored(_variability(s, d)), None
    for w, limit in _VARIABILITY.items():
        one = summary.kde(rows.filter(F.col("width") == w), ["width", "member"], 50, bounds=(-limit, limit))
        each = one if each is None else each.unionByName(one)
    kind = F.when(F.col("member") == "measured", "measured").otherwise("control")
    f4 = lambda f, out: (F.round(f("density"), 4) + 0.0).alias(out)
    return each.groupBy("width", kind.alias("kind"), n("i")).agg(f4(F.min, "least"), f4(F.avg, "mean"), f4(F.max, "most"))


_PARTS = "(SELECT CASE WHEN k THEN 'regressed' ELSE 'beyond' END AS part, t, variable, value FROM attlong, (SELECT unnest([true, false]) AS k) WHERE CASE WHEN k THEN t BETWEEN 0 AND 20 ELSE t >= 20 END)"


@query("plot_timeseries_parts", f"SELECT part, t, variable, percentile, round(value, 6) + 0.0 AS value FROM ({quantiles('part, t, variable', _PARTS)})")
def _(s, d):
    """The bands of a run, apart for the steps up to the end of a regressed range (20) and from it on, which both have."""
    rows = sumset.percentiles(_sums(s, d), ["t", "variable"])
    return products.parted(rows, 0, 20).select("part", "t", "variable", "percentile", r("value"))


_TABLE = "SELECT '{0}' AS definition, variable, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM {1} GROUP BY variable"
_DECADE = "(SELECT variable, avg(value) AS value FROM attlong WHERE t BETWEEN 17 AND 26 GROUP BY variable, model, ensemble, obs, ctl)"


@query("plot_headline_table", "SELECT definition, variable, round_even(m, 2) + 0.0 AS centre, round(m - lo, 5) AS below, round(hi - m, 5) AS above, definition || ' ' || variable || printf(': %.2f', round_even(m, 2) + 0.0) AS label FROM (" + _TABLE.format("ANNUAL", "(SELECT * FROM attlong WHERE t = 26)") + " UNION ALL " + _TABLE.format("AR6", _DECADE) + ")")
def _(s, d):
    wide, _, both = _lines(s, d)
    decade = at.wide(_windowed(9, 0)(at.long(wide, V, ["model", "ensemble", "t"]), ["model", "ensemble", "variable"]), V)
    shown = wide.withColumn("definition", F.lit("ANNUAL")).unionByName(decade.withColumn("definition", F.lit("AR6"))).filter("t = 26")
    each = at.linear(shown, both, V, keep=["definition"])
    of = lambda q: F.max(F.when(F.col("percentile") == q, F.col("value")))
    p = sumset.percentiles(each, ["definition", "variable"], [5.0, 50.0, 95.0]).groupBy("definition", "variable").agg(of(5.0).alias("lo"), of(50.0).alias("m"), of(95.0).alias("hi"))
    centre = F.bround("m", 2) + 0.0
    return p.select("definition", "variable", centre.alias("centre"), F.round(F.col("m") - F.col("lo"), 5).alias("below"), F.round(F.col("hi") - F.col("m"), 5).alias("above"), F.concat("definition", F.lit(" "), "variable", F.format_string(": %.2f", centre)).alias("label"))
