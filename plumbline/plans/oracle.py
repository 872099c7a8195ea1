"""SQL of the logical tables, as common table expressions for the oracle queries."""

from __future__ import annotations

import re

_T = "CAST((year({0}) - 1995) * 4 + quarter({0}) - 1 AS BIGINT)"

CTES = {
    "forcing": f"""SELECT variable, ensemble, t, raw / avg(raw) OVER (PARTITION BY variable, ensemble) AS value FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'GHG' WHEN 'N' THEN 'Nat' ELSE 'OHF' END AS variable, 'ens' || l_linenumber AS ensemble, {_T.format('l_shipdate')} AS t, sum(l_extendedprice * (1 - l_discount)) AS raw FROM lineitem GROUP BY 1, 2, 3)""",
    "obs": f"SELECT o_orderpriority AS member, {_T.format('o_orderdate')} AS t, avg(o_totalprice) / 1e5 AS value FROM orders GROUP BY 1, 2",
    "control": "SELECT CAST(label AS BIGINT) AS model, vec_id AS member, i AS t, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, (SELECT unnest(range(64)) AS i)",
    "slices": """SELECT model, member, slice_start, t, value - avg(value) FILTER (t < 5) OVER (PARTITION BY member, slice_start) AS value FROM (
  SELECT model, member, s * 13 AS slice_start, t - s * 13 AS t, value FROM control, (SELECT unnest(range(3)) AS s) WHERE t BETWEEN s * 13 AND s * 13 + 26)""",
    "kept": """SELECT member, slice_start FROM (
  SELECT member, slice_start, CASE WHEN count(*) OVER a = 3 THEN avg(value) OVER a END AS ma3, CASE WHEN count(*) OVER b = 9 THEN avg(value) OVER b END AS ma9 FROM slices
  WINDOW a AS (PARTITION BY member, slice_start ORDER BY t ROWS 2 PRECEDING), b AS (PARTITION BY member, slice_start ORDER BY t ROWS 8 PRECEDING))
GROUP BY 1, 2 HAVING max(ma3) < 0.3 AND min(ma3) > -0.3 AND max(ma3) - min(ma3) > 0.06 AND max(ma9) < 0.2 AND min(ma9) > -0.2""",
    "ctl": "SELECT 'c' || member || '-' || slice_start AS member, t, value FROM slices JOIN kept USING (member, slice_start)",
    "params": """SELECT 'm' || m AS model, box, power(5.0, box - 1) * (1.5 + 0.5 * m) + shift AS d, CAST(0.6 AS DOUBLE) / (box + m) AS q FROM (
  SELECT CAST(c_nationkey % 2 AS BIGINT) AS m, CAST((c_nationkey // 2) % 3 + 1 AS BIGINT) AS box, avg(c_acctbal) / 1e5 AS shift FROM customer GROUP BY 1, 2)""",
    "obsb": "SELECT member, t, value - (SELECT avg(m) FROM (SELECT quantile_cont(value, 0.5) AS m FROM obs WHERE t BETWEEN 0 AND 5 GROUP BY t)) AS value FROM obs",
    "respraw": "SELECT model, f.ensemble, f.variable, g.t, sum(q * f.value * (1 - exp(-1 / d)) * exp(-(g.t - f.t) / d)) AS value FROM forcing f JOIN forcing g ON f.variable = g.variable AND f.ensemble = g.ensemble AND f.t <= g.t CROSS JOIN params GROUP BY 1, 2, 3, 4",
    "resp": "SELECT model, ensemble, variable, t, value - avg(value) FILTER (t BETWEEN 0 AND 5) OVER (PARTITION BY model, ensemble, variable) AS value FROM respraw",
    "wide": "SELECT model, ensemble, t, max(value) FILTER (variable = 'GHG') AS g, max(value) FILTER (variable = 'Nat') AS n, max(value) FILTER (variable = 'OHF') AS o FROM resp GROUP BY 1, 2, 3",
    "targets": "SELECT 'obs' AS kind, member AS target, t, value AS y FROM obsb UNION ALL SELECT 'ctl', member, t, value FROM ctl",
    "cov": """SELECT model, ensemble, kind, target, covar_pop(g, g) AS gg, covar_pop(g, n) AS gn, covar_pop(g, o) AS go, covar_pop(n, n) AS nn, covar_pop(n, o) AS no_, covar_pop(o, o) AS oo,
  covar_pop(g, y) AS gy, covar_pop(n, y) AS ny, covar_pop(o, y) AS oy, avg(g) AS mg, avg(n) AS mn, avg(o) AS mo, avg(y) AS my
  FROM wide JOIN targets USING (t) WHERE t BETWEEN 0 AND 26 GROUP BY 1, 2, 3, 4""",
    "solved": """SELECT model, ensemble, kind, target, mg, mn, mo, my, det, (gy * (nn * oo - no_ * no_) - gn * (ny * oo - no_ * oy) + go * (ny * no_ - nn * oy)) / det AS bg,
  (gg * (ny * oo - no_ * oy) - gy * (gn * oo - no_ * go) + go * (gn * oy - ny * go)) / det AS bn, (gg * (nn * oy - ny * no_) - gn * (gn * oy - ny * go) + gy * (gn * no_ - nn * go)) / det AS bo
  FROM (SELECT *, gg * (nn * oo - no_ * no_) - gn * (gn * oo - no_ * go) + go * (gn * no_ - nn * go) AS det FROM cov)""",
    "coef": "SELECT model, ensemble, kind, target, bg, bn, bo, my - bg * mg - bn * mn - bo * mo AS b0 FROM solved",
    "pairs": "SELECT a.model, a.ensemble, a.target AS obs, b.target AS ctl, a.bg + b.bg AS bg, a.bn + b.bn AS bn, a.bo + b.bo AS bo, a.b0 + b.b0 AS b0 FROM coef a JOIN coef b ON a.model = b.model AND a.ensemble = b.ensemble AND a.kind = 'obs' AND b.kind = 'ctl'",
    "att": """SELECT w.model, w.ensemble, p.obs, p.ctl, w.t, bg * g AS GHG, bn * n AS Nat, bo * o AS OHF, bg * g + bo * o AS Ant, bg * g + bn * n + bo * o + b0 AS Tot, x.value - (bg * g + bn * n + bo * o + b0) AS Res
  FROM wide w JOIN pairs p ON w.model = p.model AND w.ensemble = p.ensemble LEFT JOIN obsb x ON x.member = p.obs AND x.t = w.t""",
    "attlong": "SELECT model, ensemble, obs, ctl, t, variable, value FROM (UNPIVOT (SELECT model, ensemble, obs, ctl, t, GHG, Nat, OHF, Ant, Tot FROM att) ON GHG, Nat, OHF, Ant, Tot INTO NAME variable VALUE value)",
    "qs": "SELECT unnest([5.0, 17.0, 83.0, 95.0, 50.0]::DOUBLE[]) AS percentile",
    "covg": """SELECT end_step, model, ensemble, kind, target, covar_pop(g, g) AS gg, covar_pop(g, n) AS gn, covar_pop(g, o) AS go, covar_pop(n, n) AS nn, covar_pop(n, o) AS no_, covar_pop(o, o) AS oo,
  covar_pop(g, y) AS gy, covar_pop(n, y) AS ny, covar_pop(o, y) AS oy, avg(g) AS mg, avg(n) AS mn, avg(o) AS mo, avg(y) AS my
  FROM wide JOIN targets USING (t) JOIN (SELECT unnest(range(15, 27)) AS end_step) ON t <= end_step WHERE t >= 0 GROUP BY 1, 2, 3, 4, 5""",
    "coefg": """SELECT *, my - bg * mg - bn * mn - bo * mo AS b0 FROM (SELECT *, (gy * (nn * oo - no_ * no_) - gn * (ny * oo - no_ * oy) + go * (ny * no_ - nn * oy)) / det AS bg,
  (gg * (ny * oo - no_ * oy) - gy * (gn * oo - no_ * go) + go * (gn * oy - ny * go)) / det AS bn, (gg * (nn * oy - ny * no_) - gn * (gn * oy - ny * go) + gy * (gn * no_ - nn * go)) / det AS bo
  FROM (SELECT *, gg * (nn * oo - no_ * no_) - gn * (gn * oo - no_ * go) + go * (gn * no_ - nn * go) AS det FROM covg))""",
    "pairsg": "SELECT end_step, a.model, a.ensemble, a.bg + b.bg AS bg, a.bn + b.bn AS bn, a.bo + b.bo AS bo, a.b0 + b.b0 AS b0 FROM coefg a JOIN coefg b USING (end_step, model, ensemble) WHERE a.kind = 'obs' AND b.kind = 'ctl'",
    "attg": """SELECT end_step, t, variable, value FROM (UNPIVOT (SELECT end_step, t, bg * g AS GHG, bn * n AS Nat, bo * o AS OHF, bg * g + bo * o AS Ant, bg * g + bn * n + bo * o + b0 AS Tot
  FROM wide JOIN pairsg USING (model, ensemble) WHERE t IN (26, end_step, end_step - 1)) ON GHG, Nat, OHF, Ant, Tot INTO NAME variable VALUE value)""",
    "x1": "SELECT model, ensemble, t, g + n + o AS x FROM wide",
    "targ1": "SELECT model, ensemble, kind, target, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x1 JOIN targets USING (t) WHERE t BETWEEN 0 AND 26 GROUP BY 1, 2, 3, 4",
    "att1": """SELECT x.model, x.ensemble, p.target AS obs, c.target AS ctl, x.t, (p.b + c.b) * x.x + p.a + c.a AS Tot FROM x1 x JOIN targ1 p ON x.model = p.model AND x.ensemble = p.ensemble AND p.kind = 'obs' JOIN targ1 c ON x.model = c.model AND x.ensemble = c.ensemble AND c.kind = 'ctl'""",
    "cov2": """SELECT model, ensemble, kind, target, covar_pop(h, h) AS hh, covar_pop(h, n) AS hn, covar_pop(n, n) AS nn, covar_pop(h, y) AS hy, covar_pop(n, y) AS ny, avg(h) AS mh, avg(n) AS mn, avg(y) AS my
  FROM (SELECT model, ensemble, t, g + o AS h, n FROM wide) JOIN targets USING (t) WHERE t BETWEEN 0 AND 26 GROUP BY 1, 2, 3, 4""",
    "coef2": """SELECT *, my - bh * mh - bn * mn AS b0 FROM (SELECT *, (hy * nn - hn * ny) / (hh * nn - hn * hn) AS bh, (hh * ny - hn * hy) / (hh * nn - hn * hn) AS bn FROM cov2)""",
    "att2": """SELECT w.model, w.ensemble, p.target AS obs, c.target AS ctl, w.t, (p.bh + c.bh) * (g + o) AS Ant, (p.bn + c.bn) * n AS Nat, (p.bh + c.bh) * (g + o) + (p.bn + c.bn) * n + p.b0 + c.b0 AS Tot
  FROM wide w JOIN coef2 p ON w.model = p.model AND w.ensemble = p.ensemble AND p.kind = 'obs' JOIN coef2 c ON w.model = c.model AND w.ensemble = c.ensemble AND c.kind = 'ctl'""",
}


def quantiles(keys: str, source: str, value: str = "value") -> str:
    """Rows keys, percentile, value of the five percentiles."""
    parts = [f"SELECT {keys}, CAST({q} AS DOUBLE) AS percentile, quantile_cont({value}, {q / 100}) AS value FROM {source} GROUP BY ALL" for q in (5, 17, 83, 95, 50)]
    return " UNION ALL ".join(parts)


CTES["runs"] = quantiles("end_step, t, variable", "attg")
CTES["att2long"] = "SELECT t, variable, value FROM (UNPIVOT (SELECT t, Ant, Nat, Tot FROM att2) ON Ant, Nat, Tot INTO NAME variable VALUE value)"
CTES["repeated"] = "SELECT r AS repeat_id, t, variable, value FROM attlong, (SELECT unnest([1, 2, 3]) AS r) WHERE CAST(substr(ensemble, 4) AS INTEGER) % 3 < r AND NOT (r = 2 AND t = 0)"
CTES["repeats"] = f"SELECT * FROM ({quantiles('repeat_id, t, variable, count(*) AS weight', 'repeated')})"
_ORDER = ["forcing", "obs", "control", "slices", "kept", "ctl", "params", "obsb", "respraw", "resp", "wide", "targets", "cov", "solved", "coef", "pairs", "att", "attlong", "qs", "covg", "coefg", "pairsg", "attg", "x1", "targ1", "att1", "cov2", "coef2", "att2", "att2long", "runs", "repeated", "repeats"]


def sql(body: str) -> str:
    """The body with the definitions of the logical tables it names, directly or through others."""
    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    defs = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in _ORDER if n in needed)
    return f"WITH {defs}\n{body}" if defs else body
