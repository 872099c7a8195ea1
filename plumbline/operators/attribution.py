"""From responses and targets to attributed series.

Measurements and control noise are regressed separately and their coefficients are
added for every pairing, so fits grow with the sum of the members, not the product. What is reported of the pairs is
taken from the two sides (``sums``); ``paired`` and ``attributed`` give the pairs themselves. Headlines that are
linear in time are taken of the responses before the pairing, never of the product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import bucketed, observed, stored
from .regression import fit, growing_weights, range_weights, weights
from .sumset import Linear

VARIABLES = ["GHG", "Nat", "OHF"]


def shown_variables(variables: list[str]) -> list[str]:
    """The columns of ``attributed`` but Res."""
    return [v for v in variables if v != "Tot"] + (["Ant"] if {"GHG", "OHF"} <= set(variables) else []) + ["Tot"]


def wide(response: DataFrame, variables: list[str]) -> DataFrame:
    return response.groupBy("model", "ensemble", "t").pivot("variable", variables).agg(F.first("value"))


#: Response members whose weights are broadcast to the targets.
MOST_RESPONSES = 10_000
#: Coefficients that an array holds at most; more members are several arrays.
MEMBERS = 1 << 16
#: Numbers that a task forms, about, and coefficients that are broadcast to the responses.
VALUES, MOST_COEFFICIENTS = 1 << 20, 500_000
#: Coefficients of a bucket, about, where there are more than are broadcast.
BUCKET = 100_000
#: Files of paired blocks of coefficients, about, if there are as many blocks.
FILES = 512


def _targets(obs: DataFrame, ctl: DataFrame, first: int, last: int) -> DataFrame:
    of = lambda kind, df: df.filter(F.col("t").between(first, last)).select(F.lit(kind).alias("kind"), F.col("member").alias("target"), "t", F.col("value").alias("y"))
    return of("obs", obs).union(of("ctl", ctl))


def _packed(targets: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """kind, target, ys (by step) of the targets that have each of the n steps once, and kind, target of the others, if there are any."""
    series = targets.filter("y is not null").groupBy("kind", "target").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("s"), F.countDistinct("t").alias("n"))
    whole = (F.col("n") == n) & (F.size("s") == n)
    series, seen = observed(series, others=F.count_if(~whole))
    return series.filter(whole).select("kind", "target", F.col("s.y").alias("ys")), series.filter(~whole).select("kind", "target") if seen["others"] else None


def _each(packed: DataFrame, responses: DataFrame) -> DataFrame:
    """Every target with every response member, whose rows are few next to the targets."""
    responses, seen = observed(responses, n=F.count("*"))
    return packed.crossJoin(F.broadcast(responses) if seen["n"] <= MOST_RESPONSES else responses)


def coefficients(wide: DataFrame, obs: DataFrame, ctl: DataFrame, variables: list[str], first: int, last: int) -> DataFrame:
    """model, ensemble, kind, target, b_<variable>, b_const of both kinds of targets, on responses with a column for each variable.

    Regressors are inverted once for each response member, and a target with all their steps is a row whose coefficients are sums
    of products with those weights; others are fitted each on the steps that they have.
    """
    rows = stored(wide.filter(F.col("t").between(first, last)))
    keys, names = ["model", "ensemble", "kind", "target"], [*variables, "const"]
    steps, seen = observed(rows.select("t").distinct(), n=F.count("*"))
    n = seen["n"]
    targets = _targets(obs, ctl, first, last).join(F.broadcast(steps), "t", "left_semi")
    if rows.groupBy("model", "ensemble").count().filter(F.col("count") != n).limit(1).count():
        return fit(rows.join(targets, "t"), keys, variables)
    packed, rest = _packed(targets, n)
    w = weights(rows, ["model", "ensemble"], variables).groupBy("model", "ensemble").agg(F.array_sort(F.collect_list(F.struct("t", *(f"w_{v}" for v in names)))).alias("w"))
    dot = lambda v: F.aggregate(F.zip_with("ys", F.col(f"w.w_{v}"), lambda y, x: y * x), F.lit(0.0), lambda a, x: a + x)
    found = _each(packed, w).select(*keys, *(dot(v).alias(f"b_{v}") for v in names))
    if rest is None:
        return found
    return found.unionByName(fit(rows.join(targets.join(rest, ["kind", "target"], "left_semi"), "t"), keys, variables))


def growing_coefficients(wide: DataFrame, obs: DataFrame, ctl: DataFrame, variables: list[str], first: int, least: int, last: int) -> DataFrame:
    """end_step, model, ensemble, kind, target, b_<variable>, b_const for every range from first to an end step of ``least`` rows and more.

    One pass over the steps of each target: its coefficients move by what the next step's value differs from them, times a gain
    that is the response member's alone (``growing_weights``). Targets have every step; those with gaps are left out, as are responses with gaps.
    """
    rows = stored(wide.filter(F.col("t").between(first, last)))
    names = [*variables, "const"]
    steps, seen = observed(rows.select("t").distinct(), n=F.count("*"))
    n = seen["n"]
    packed, _ = _packed(_targets(obs, ctl, first, last).join(F.broadcast(steps), "t", "left_semi"), n)
    gains = growing_weights(rows, ["model", "ensemble"], variables, least)
    dot = lambda w, ys: F.aggregate(F.zip_with(ys, w, lambda y, x: y * x), F.lit(0.0), lambda a, x: a + x)
    start = F.struct(*(dot(F.col(f"start.{v}"), F.slice("ys", 1, least)).alias(v) for v in names))
    before = F.struct(start.alias("b"), F.array(F.struct(F.col("steps")[least - 1]["t"].alias("end_step"), *(start[v].alias(v) for v in names))).alias("out"))

    def move(acc, step):
        seen = sum((acc["b"][v] * step[f"x_{v}"] for v in variables), acc["b"]["const"])
        b = F.struct(*((acc["b"][v] + step[f"k_{v}"] * (step["y"] - seen)).alias(v) for v in names))
        return F.struct(b.alias("b"), F.concat(acc["out"], F.array(F.struct(step["t"].alias("end_step"), *(b[v].alias(v) for v in names)))).alias("out"))

    later = F.zip_with(F.slice("steps", least + 1, n), F.slice("ys", least + 1, n), lambda s, y: F.struct(s["t"].alias("t"), y.alias("y"), *(s[f"x_{v}"].alias(f"x_{v}") for v in variables), *(s[f"k_{v}"].alias(f"k_{v}") for v in names)))
    fitted = _each(packed, gains).select("model", "ensemble", "kind", "target", F.explode(F.aggregate(later, before, move, lambda acc: acc["out"])).alias("e"))
    return fitted.select("e.end_step", "model", "ensemble", "kind", "target", *(F.col(f"e.{v}").alias(f"b_{v}") for v in names))


@dataclass(frozen=True)
class Sides:
    """Arrays of the coefficients of each response member, of measured and of control members, for several ``sums`` of them."""

    obs: DataFrame
    ctl: DataFrame
    most: int  # coefficients of a kind that a response member has
    at: list[str]
    buckets: int  # of the tables that both kinds are, by ``at``; 0 where they are broadcast

    def laid(self, responses: DataFrame) -> tuple[DataFrame, int]:
        """The responses from a table that meets the coefficients without an exchange, and how many they are."""
        if not self.buckets:
            table, seen = observed(responses, n=F.count("*"))
            return table, seen["n"]
        table = bucketed(responses, self.at, self.buckets)
        return table, table.count()


def sides(coef: DataFrame, variables: list[str], on: list[str] | None = None, bucket: bool | None = None) -> Sides:
    """Both kinds' arrays; ``bucket`` says whether they are bucketed tables, or else their number does."""
    at, names = ["model", "ensemble", *(on or [])], [f"b_{v}" for v in [*variables, "const"]]
    sizes = coef.groupBy(*at, "kind").count().groupBy(*at).agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    sizes = sizes.agg(F.max("most").alias("most"), F.sum("all").alias("all"), F.count("*").alias("members")).first()
    most, buckets = sizes.most or 0, 0
    if sizes.all and (bucket or bucket is None and sizes.all > MOST_COEFFICIENTS):
        # A member's coefficients are in one bucket, and all members have about as many, so more buckets than members would be empty ones.
        buckets = min(sizes.members, -(-sizes.all // BUCKET))
        coef = coef.repartition(buckets, *at)
    block = F.pmod(F.xxhash64("target"), F.lit(-(-most // MEMBERS) or 1))

    def own(kind: str, *columns: str) -> DataFrame:
        arrays = coef.filter(F.col("kind") == kind).groupBy(*at, block.alias("block")).agg(F.collect_list(F.struct(*columns)).alias(kind)).drop("block")
        return bucketed(arrays, at, buckets, placed=True) if buckets else arrays

    return Sides(own("obs", "target", *names), own("ctl", *names), most, at, buckets)


def sums(response_wide: DataFrame, coef: DataFrame | Sides, variables: list[str], obs: DataFrame | None = None, const: float = 1.0, on: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """model, ensemble, t, variable, a, c (and ``on``): what ``attributed`` gives for every pair, as the sums of two arrays.

    Every shown value of a pair is one number of its measured member and one of its control member, so a row is a variable of a
    step of a response member, whatever the number of pairs. With ``obs`` there is Res, for the members measured at the step.
    ``on``: further columns of both frames that tell coefficients apart. ``rows``: the number of responses' rows, where it is known.
    Coefficients too many for a broadcast are tables bucketed by response member, and responses that are ``laid`` out alike meet them where they are.
    """
    at, own = ["model", "ensemble", *(on or [])], coef if isinstance(coef, Sides) else sides(coef, variables, on)
    if own.buckets:
        both = response_wide.join(own.obs.hint("merge"), at).join(own.ctl.hint("merge"), at)
    else:
        # Rows are few and arrays long: as many tasks as the numbers they hold ask for, not as the rows do.
        tasks = max(1, -(-(response_wide.count() if rows is None else rows) * (len(variables) + 3) * own.most // VALUES))
        both = response_wide.repartition(tasks).join(F.broadcast(own.obs), at).join(F.broadcast(own.ctl), at)
    times = lambda v: lambda x: x[f"b_{v}"] * F.col(v)
    part = {v: times(v) for v in variables}
    total = lambda x: sum((part[v](x) for v in variables), x["b_const"] * const)
    shown = {v: f for v, f in part.items() if v != "Tot"}
    if {"GHG", "OHF"} <= set(variables):
        shown["Ant"] = lambda x: part["GHG"](x) + part["OHF"](x)
    shown["Tot"] = total
    arrays = [F.struct(F.lit(v).alias("variable"), F.transform("obs", f).alias("a"), F.transform("ctl", f).alias("c")) for v, f in shown.items()]
    if obs is not None:
        measured = obs.filter("value is not null").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("o"))
        both = both.join(measured, "t", "left")
        has = F.filter("obs", lambda x: F.coalesce(F.map_contains_key("o", x["target"]), F.lit(False)))
        arrays.append(F.struct(F.lit("Res").alias("variable"), F.transform(has, lambda x: F.col("o")[x["target"]] - total(x)).alias("a"), F.transform("ctl", lambda x: -total(x)).alias("c")))
    return both.select(*at, "t", F.explode(F.array(*arrays)).alias("x")).select(*at, "t", "x.variable", "x.a", "x.c")


def met(coef: DataFrame, variables: list[str], on: list[str] | None = None) -> DataFrame:
    """at, obs, ctl: a stored row for each pair of blocks of a response member's coefficients, which any number of ``linear`` points are taken at."""
    own = sides(coef, variables, on, bucket=False)
    few = coef.filter("kind = 'obs'").count() <= MOST_COEFFICIENTS
    both = own.ctl.join(F.broadcast(own.obs) if few else own.obs, own.at).select(*own.at, "obs", "ctl")
    blocks = coef.select(*own.at).distinct().count() * -(-own.most // MEMBERS) ** 2
    return stored(both, max(1, blocks // FILES))


#: Targets of a block, at least and at most, and rows of blocks that there are at least, so that few targets are many tasks' work, too.
BLOCK, LEAST_ROWS = (8192, 32768), 32


@dataclass(frozen=True)
class Series:
    """The targets themselves, in blocks, and what each of their steps counts for in every coefficient (``weights``).

    A coefficient is a sum of a target's steps times weights of the response member (and range) alone, so whatever is linear in coefficients is linear in
    the steps, with factors that are few. What is written is a target's steps once, for all response members and ranges.
    """

    weights: DataFrame  # model, ensemble, w_<variable>, w_const (arrays by step), and end_step of growing ranges
    sides: DataFrame  # part, obs, ctl; every part has all pairs of blocks
    parts: int


def _blocks(targets: DataFrame, name: str, named: bool, size: int) -> DataFrame:
    """``name``: arrays of the ys of up to ``size`` targets of a task, and with ``named`` of their names."""
    kind = f"struct<{'target: string, ' if named else ''}y: array<double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def write(n: int) -> tuple[pa.RecordBatch, list, int]:
            whole = pa.Table.from_batches(held).combine_chunks()
            first, rest = whole.slice(0, n), whole.slice(n)
            columns = {"target": first.column("target"), "y": first.column("ys")} if named else {"y": first.column("ys")}
            rows = pa.StructArray.from_arrays([pa.concat_arrays(c.chunks) for c in columns.values()], list(columns))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows)], [name]), rest.to_batches(), rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            while n >= size:
                out, held, n = write(size)
                yield out
        if n:
            yield write(n)[0]

    return targets.select(F.col("target").cast("string").alias("target"), F.col("ys").cast("array<double>").alias("ys")).mapInArrow(run, f"{name} array<{kind}>")


def series(wide: DataFrame, obs: DataFrame, ctl: DataFrame, variables: list[str], first: int, last: int, least: int | None = None) -> Series | None:
    """For ``linear`` of all targets: of the steps first..last, or with ``least`` of every range of that many steps and more.

    ``obs`` has rows member, t, value; ``ctl`` has target, ys, the numbers of all steps first..last. None where the responses or
    measurements lack a step or have one twice, so that weights do not hold for all: ``coefficients`` fit those.
    """
    n, keys = last - first + 1, ["model", "ensemble"]
    rows = stored(wide.filter(F.col("t").between(first, last)))
    if rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("t").alias("d")).filter(f"n <> {n} or d <> {n}").limit(1).count():
        return None
    measured = obs.filter(F.col("t").between(first, last)).groupBy(F.col("member").alias("target")).agg(F.array_sort(F.collect_list(F.struct("t", F.col("value").alias("y")))).alias("s"), F.countDistinct("t").alias("d"))
    whole = (F.size("s") == n) & (F.col("d") == n) & F.col("target").isNotNull() & F.forall("s.y", lambda y: y.isNotNull())
    measured, seen = observed(measured, odd=F.count_if(~whole))
    if seen["odd"]:
        return None
    if least is None:
        own = weights(rows, keys, variables)
        steps = F.array_sort(F.collect_list(F.struct("t", *(f"w_{v}" for v in [*variables, "const"]))))
        found = own.groupBy(*keys).agg(steps.alias("s")).select(*keys, *(F.col(f"s.w_{v}").alias(f"w_{v}") for v in [*variables, "const"]))
    else:
        found = range_weights(rows, keys, variables, least)
    obs_blocks = _blocks(measured.select("target", F.col("s.y").alias("ys")).coalesce(1), "obs", True, BLOCK[1])
    size = min(BLOCK[1], max(BLOCK[0], ctl.count() // LEAST_ROWS))
    blocks, seen = observed(_blocks(ctl, "ctl", False, size), 1, n=F.count("*"))
    parts = max(1, -(-LEAST_ROWS // max(1, seen["n"])))
    both = blocks.crossJoin(F.broadcast(obs_blocks)) if measured.count() <= MOST_COEFFICIENTS else blocks.crossJoin(obs_blocks)
    if parts > 1:
        both = stored(both.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "obs", "ctl"), 1)
    else:
        both = both.select(F.lit(0).alias("part"), "obs", "ctl")
    return Series(stored(found), both, parts)


def points_of(response_wide: DataFrame, of: Series, variables: list[str], obs: DataFrame | None = None, const: float = 1.0, on: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """part and what ``points`` gives, as the targets' steps and what they are multiplied by."""
    own = ["model", "ensemble", *(on or [])]
    names = [*variables, "const"]
    rows = response_wide.join(F.broadcast(of.weights), own)
    step = lambda shown: F.array(F.struct(F.lit("y").alias("name"), F.transform(F.sequence(F.lit(0), F.size("w_const") - 1), lambda i: sum((F.col(f"w_{v}")[i] * (F.lit(const) if v == "const" else F.col(v)) for v in shown[1:]), F.col(f"w_{shown[0]}")[i] * F.col(shown[0]))).alias("x")))
    shown = {v: step([v]) for v in variables if v != "Tot"}
    if {"GHG", "OHF"} <= set(variables):
        shown["Ant"] = step(["GHG", "OHF"])
    shown["Tot"] = step(names)
    nothing = F.lit(None).cast("map<string,double>")
    each = [F.struct(F.lit(v).alias("variable"), terms.alias("terms"), nothing.alias("measured")) for v, terms in shown.items()]
    if obs is not None:
        rows = rows.join(_measured(obs), "t", "left")
        each.append(F.struct(F.lit("Res").alias("variable"), shown["Tot"].alias("terms"), F.coalesce("o", F.create_map().cast("map<string,double>")).alias("measured")))
    at = [*own, *(keep or []), "t"]
    part = F.pmod(F.xxhash64(*at, "p.variable"), F.lit(of.parts)).cast("int").alias("part")
    return rows.select(*at, F.explode(F.array(*each)).alias("p")).select(part, *at, "p.variable", "p.terms", "p.measured")


def _measured(obs: DataFrame) -> DataFrame:
    """t, o: the members' numbers by their names."""
    return obs.filter("value is not null").groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct(F.col("member").cast("string"), F.col("value").cast("double")))).alias("o"))


def points(response_wide: DataFrame, variables: list[str], obs: DataFrame | None = None, const: float = 1.0, on: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """model, ensemble, t (with ``on``, and what to ``keep``), variable, terms, measured: what ``sums`` forms arrays of, as the names of coefficients and what they are multiplied by."""
    term = lambda name, x: F.struct(F.lit(f"b_{name}").alias("name"), x.cast("double").alias("x"))
    part = {v: term(v, F.col(v)) for v in variables}
    total = F.array(term("const", F.lit(const)), *part.values())
    shown = {v: F.array(x) for v, x in part.items() if v != "Tot"}
    if {"GHG", "OHF"} <= set(variables):
        shown["Ant"] = F.array(part["GHG"], part["OHF"])
    shown["Tot"] = total
    nothing = F.lit(None).cast("map<string,double>")
    point = lambda v, terms, measured: F.struct(F.lit(v).alias("variable"), terms.alias("terms"), measured.alias("measured"))
    each = [point(v, terms, nothing) for v, terms in shown.items()]
    if obs is not None:
        response_wide = response_wide.join(_measured(obs), "t", "left")
        each.append(point("Res", total, F.coalesce("o", F.create_map().cast("map<string,double>"))))
    at = ["model", "ensemble", *(on or []), *(keep or [])]
    return response_wide.select(*at, "t", F.explode(F.array(*each)).alias("p")).select(*at, "t", "p.variable", "p.terms", "p.measured")


def linear(response_wide: DataFrame, both: DataFrame | Series | None, variables: list[str], obs: DataFrame | None = None, const: float = 1.0, on: list[str] | None = None, keep: list[str] | None = None) -> Linear:
    """What ``sums`` gives for every pair, of what has ``met`` or of ``series``, with arrays formed where they are counted and never written: for any number of members."""
    if isinstance(both, Series):
        return Linear(points_of(response_wide, both, variables, obs, const, on, keep), both.sides, ["part"])
    return Linear(points(response_wide, variables, obs, const, on, keep), both, ["model", "ensemble", *(on or [])])


def paired(coef: DataFrame, variables: list[str]) -> DataFrame:
    """model, ensemble, obs, ctl and the sums of the coefficients of every pair, within each response member."""
    names = [*(f"b_{v}" for v in variables), "b_const"]
    side = lambda k: coef.filter(F.col("kind") == k).select("model", "ensemble", F.col("target").alias(k), *(F.col(n).alias(f"{k}_{n}") for n in names))
    return side("obs").join(side("ctl"), ["model", "ensemble"]).select("model", "ensemble", "obs", "ctl", *((F.col(f"obs_{n}") + F.col(f"ctl_{n}")).alias(n) for n in names))


def attributed(response_wide: DataFrame, pairs: DataFrame, variables: list[str], obs: DataFrame | None = None, const: float = 1.0) -> DataFrame:
    """One column for each variable, Ant (without the constant) and Tot (with it), and Res where the measurements reach.

    Of one regressed variable, Tot, the part is written over by the total with its constant.
    """
    both = response_wide.join(pairs, ["model", "ensemble"])
    part = {v: F.col(f"b_{v}") * F.col(v) for v in variables}
    total = sum(part.values(), F.lit(0.0)) + F.col("b_const") * const
    derived = {"Ant": part["GHG"] + part["OHF"]} if {"GHG", "OHF"} <= set(variables) else {}
    shown = both.select("model", "ensemble", "obs", "ctl", "t", *(c.alias(v) for v, c in {**part, **derived, "Tot": total}.items()))
    if obs is None:
        return shown
    return shown.join(obs.select(F.col("member").alias("obs"), "t", F.col("value").alias("o")), ["obs", "t"], "left").withColumn("Res", F.col("o") - F.col("Tot")).drop("o")


def long(shown: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    return shown.unpivot(keys, variables, "variable", "value")
