"""URL filters: explicit allow and block rules, then mined association rules, in DataFrame operations only.

``mine`` feeds the URL tokens of labelled pages, with the label as one more item, to
Spark's FP-growth, and keeps rules whose consequent is a label, pruned by support
(a share of the labelled pages, and ``MIN_PAGES`` pages at least), confidence and lift. Tokens on fewer pages can be in no such
rule and are left out before; of tokens that stand on exactly the same labelled pages (a host and its labels, say) the first stands for all, and tokens on
every page are left out too: they would double the itemsets without another rule to show for it. What is left of a URL bounds the
itemsets' length. ``match`` finds the rules of each URL through an inverted index:
every rule stands under its rarest token, a URL looks up its own tokens there, and a
rule applies if the URL has all of its tokens. The most confident rule wins (ties: more
support, then the longer, then block, then the antecedent's text).

Cases: a null url or one without ``://`` has an empty host and path, no token and no
rule, and is allowed; labels without a page, or null labels, teach nothing; a page labelled
more than once counts each time; with no labelled page there are no rules; repeated
pages are judged row by row; a very long url is one row like any other; no pages give no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (host, path, verdict) of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Explicit rules that are held in the plan; more of them are joined.
MOST_RULES = 1000
MIN_PAGES, MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 5, 0.01, 0.5, 1.1


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return pages.select("page_id", "url", F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("host"), path.alias("path"))


def fitting(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``fit``: a struct with rule and verdict of the longest explicit rule that fits host and path (of equal rules, the one that blocks)."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(F.concat(F.lit("."), h))) & F.col("path").startswith(p)
    if len(rules) <= MOST_RULES:
        entries = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p, v in rules))
        return parts.withColumn("fit", F.array_max(F.filter(entries, lambda r: fits(r["h"], r["p"]))))
    listed = parts.sparkSession.createDataFrame([(len(h + p), h + p, v, h, p) for h, p, v in rules], "n int, rule string, verdict string, h string, p string")
    # A rule's host is the page's host or one of its ends after a dot.
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = parts.select("host", "path").distinct().withColumn("h", F.explode(ends)).join(listed, "h").filter(F.col("path").startswith(F.col("p")))
    best = places.groupBy("host", "path").agg(F.max(F.struct("n", "rule", "verdict", "h", "p")).alias("fit"))
    return parts.join(best, ["host", "path"], "left")


def tokens():
    """Distinct typed tokens of a URL: scheme, host suffixes and labels, path segments, extension, query keys, fragment."""
    labels = F.split("host", r"\.")
    of = lambda kind, words: F.transform(F.filter(words, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.split(F.regexp_extract("url", r"(?s)\?([^#]*)", 1), "&")
    parts = [
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract("url", r"(?s)^(.*?)://", 1))),
        F.array(F.concat(F.lit("host:"), F.col("host"))), of("label:", labels),
        of("segment:", F.split("path", "/")), of("ext:", F.array(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))),
        of("query:", F.transform(query, lambda x: F.regexp_extract(x, r"^[^=]*", 0))), of("fragment:", F.array(F.regexp_extract("url", r"(?s)#(.*)$", 1))),
    ]
    return F.when(F.col("host") != "", F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


def useful_tokens(labelled: DataFrame, least: int, pages: int) -> DataFrame:
    """token, freq of the tokens of rows (page, tokens) on ``least`` pages or more, but not on all; of tokens on the same pages the first."""
    each = labelled.select(F.xxhash64("page").alias("page"), F.explode("tokens").alias("token"))
    # Equal sets of pages have equal sums of hashed page numbers.
    counted = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.col("page").cast("decimal(38,0)")).alias("pages"))
    kept = counted.filter((F.col("freq") >= least) & (F.col("freq") < pages))
    return kept.groupBy("freq", "pages").agg(F.min("token").alias("token")).select("token", "freq")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES) -> DataFrame:
    """anchor, antecedent, verdict, confidence, support from rows (tokens, bad)."""
    known = cut(labelled.filter(F.col("bad").isNotNull()).select(F.monotonically_increasing_id().alias("page"), "tokens", "bad"))
    pages = known.count()
    support = max(min_support, min_pages / max(pages, 1))
    useful = cut(useful_tokens(known, math.ceil(support * pages - 1e-9), pages))
    left = known.select("page", F.explode("tokens").alias("token")).join(useful, "token").groupBy("page").agg(F.collect_list("token").alias("left"))
    verdict = F.when(F.col("bad"), F.lit("=block")).otherwise(F.lit("=allow"))
    items = cut(known.join(left, "page", "left").select(F.concat(F.coalesce("left", F.array().cast("array<string>")), F.array(verdict)).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(support, 1.0), minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter((F.size("consequent") == 1) & F.col("consequent")[0].isin("=block", "=allow") & (F.col("lift") >= min_lift) & (F.col("support") * pages >= min_pages - 0.5))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 9).alias("verdict"), "confidence", "support")
    rarest = rules.select("*", F.explode("antecedent").alias("token")).join(useful, "token").groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    return cut(rarest)


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, mined: the best rule of each distinct url that has one."""
    distinct = pages.filter(F.size("tokens") > 0).select("url", "tokens").dropDuplicates(["url"])
    found = distinct.select("url", "tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    key = F.struct("confidence", "support", F.size("antecedent").alias("size"), (F.col("verdict") == "block").alias("block"), F.array_join("antecedent", " ").alias("tokens"), "verdict")
    return found.groupBy("url").agg(F.max(key).alias("mined"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, **pruning) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every page."""
    parts = with_parts(pages).withColumn("tokens", tokens())
    known = labels.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    found = match(parts, mine(parts.join(known, "page_id").select("tokens", "bad"), **pruning))
    both = fitting(parts, rules).join(found, "url", "left")
    return both.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "mined.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("fit").isNull(), F.col("mined.tokens")).alias("mined_rule"), F.when(F.col("fit").isNull(), F.col("mined.confidence")).alias("confidence"),
    )


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


#: What each kind of token is made of, in the SQL.
_WORDS = {
    "scheme": "[regexp_extract(url, '(?s)^(.*?)://', 1)]", "host": "[host]", "label": "string_split(host, '.')", "segment": "string_split(path, '/')", "ext": r"[regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)]",
    "query": r"list_transform(string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&'), lambda x: regexp_extract(x, '^[^=]*'))", "fragment": "[regexp_extract(url, '(?s)#(.*)$', 1)]",
}
_LISTED = ", ".join(f"({len(h + p)}, '{h}', '{p}', '{v}')" for h, p, v in RULES)
_SUPPORT = f"greatest({MIN_SUPPORT}::DOUBLE, {MIN_PAGES}::DOUBLE / pages)"
#: The same by counting all sets of useful tokens that some labelled page has.
ORACLE = f"""WITH RECURSIVE rests AS (SELECT row_number() OVER () AS p, page_id, url, CASE WHEN contains(url, '://') THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS MATERIALIZED (SELECT p, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '(?s)^[^/?#]*(/[^?#]*)', 1) AS path FROM rests),
tokens AS MATERIALIZED (SELECT DISTINCT p, kind || ':' || x AS token FROM ({" UNION ALL ".join(f"SELECT p, host, '{kind}' AS kind, unnest({of}) AS x FROM parts" for kind, of in _WORDS.items())}) WHERE host <> '' AND (x <> '' OR kind IN ('scheme', 'host'))),
known AS MATERIALIZED (SELECT row_number() OVER () AS k, p, bad, count(*) OVER () AS pages FROM (SELECT p, toxic = 1 OR quality = 0 AS bad FROM parts JOIN labels ON page_id = doc_id) WHERE bad IS NOT NULL),
held AS MATERIALIZED (SELECT token, freq, on_pages FROM (SELECT token, count(*) AS freq, any_value(pages) AS pages, list(k ORDER BY k) AS on_pages FROM known JOIN tokens USING (p) GROUP BY 1) WHERE freq >= ceil({_SUPPORT} * pages - 1e-9) AND freq < pages),
useful AS MATERIALIZED (SELECT min(token) AS token FROM held GROUP BY freq, on_pages),
left_on AS MATERIALIZED (SELECT k, bad, pages, token FROM known JOIN tokens USING (p) JOIN useful USING (token)),
sets AS (SELECT k, bad, pages, [token] AS items FROM left_on UNION ALL SELECT s.k, s.bad, s.pages, list_append(items, l.token) FROM sets s JOIN left_on l ON s.k = l.k AND l.token > items[-1]),
counted AS MATERIALIZED (SELECT items, any_value(pages) AS pages, count(*) AS n, count_if(bad) AS bad FROM sets GROUP BY 1),
shares AS (SELECT count_if(bad) AS bad, count(*) AS n FROM known),
mined AS MATERIALIZED (SELECT items, verdict, joint::DOUBLE / c.n AS confidence, joint::DOUBLE / pages AS support
  FROM (SELECT items, pages, n, bad AS joint, 'block' AS verdict FROM counted UNION ALL SELECT items, pages, n, n - bad, 'allow' FROM counted) c CROSS JOIN shares s
  WHERE joint >= ceil({_SUPPORT} * pages - 1e-9) AND joint >= {MIN_PAGES} AND joint::DOUBLE / c.n >= {MIN_CONFIDENCE} AND joint::DOUBLE / c.n / ((CASE verdict WHEN 'block' THEN s.bad ELSE s.n - s.bad END)::DOUBLE / s.n) >= {MIN_LIFT}),
urls AS (SELECT any_value(p) AS p, url FROM parts WHERE host <> '' GROUP BY url),
listed AS MATERIALIZED (SELECT url, list(token) AS own FROM urls JOIN tokens USING (p) GROUP BY 1),
matched AS (SELECT url, max(struct_pack(confidence := confidence, support := support, size := len(items), block := verdict = 'block', tokens := array_to_string(items, ' '), verdict := verdict)) AS best FROM listed JOIN mined ON list_has_all(own, items) GROUP BY 1),
fits AS (SELECT p, max(struct_pack(n := n, rule := h || start, verdict := verdict)) AS fit FROM parts JOIN (VALUES {_LISTED}) r(n, h, start, verdict) ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, fit.rule AS rule, coalesce(fit.verdict, best.verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (p) LEFT JOIN matched USING (url)"""
