"""Linear responses: three-box temperature model and impulse-response kernels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import observed, stored
from . import scan

#: Models whose boxes are broadcast.
MOST_MODELS = 10_000


def box_response(forcing: DataFrame, params: DataFrame, midpoint: bool = False) -> DataFrame:
    """model, ensemble, variable, t, value: the sum of the boxes' states, each S <- S e^(-1/d) + q F (1 - e^(-1/d)).

    ``midpoint`` takes the mean of the state before and after the step. Series are scanned in blocks of steps (``scan``), each with all
    models; parameters are one row for each model, broadcast behind a check of their number.
    """
    series, of_series = observed(scan.blocks(forcing, ["variable", "ensemble"], "t", ["value"]), last=F.max("block"))
    boxes, of_boxes = observed(params.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("box", "d", "q"))).alias("boxes")), n=F.count("*"))
    keep, add = lambda b: F.exp(-1 / b["d"]), lambda b: b["q"] * -F.expm1(-1 / b["d"])
    folded = F.transform("boxes", lambda b: scan.folded(F.col("s"), lambda x: keep(b), lambda x: add(b) * x["value"]))
    rows = series.crossJoin(F.broadcast(boxes) if of_boxes["n"] <= MOST_MODELS else boxes).select("model", "ensemble", "variable", "block", F.col("s.t").alias("t"), folded.alias("f"))
    nothing = F.transform("f", lambda _: F.lit(0.0))
    keys = ["model", "ensemble", "variable"]
    if not of_series["last"]:
        whole = rows.withColumn("before", nothing)
    else:
        rows = stored(rows)
        last = rows.select(*keys, "block", F.posexplode(F.transform("f", lambda f: F.element_at(f, -1))).alias("box", "end"))
        ends = last.select(*keys, "box", "block", F.col("end.left").alias("k0"), F.col("end.state").alias("a0"))
        carried = scan.carried(ends, [*keys, "box"], 1)
        before = carried.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("box", "c0")))["c0"].alias("before"))
        whole = rows.join(before, [*keys, "block"], "left").withColumn("before", F.coalesce("before", nothing))
    each = F.zip_with("f", "before", lambda f, c: F.transform(f, lambda x: x["state"] + x["left"] * c))
    total = F.aggregate(each, F.transform("t", lambda _: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    if midpoint:
        start = F.aggregate("before", F.lit(0.0), lambda a, c: a + c)
        total = F.zip_with(total, F.concat(F.array(start), F.slice(total, 1, F.size("t") - 1)), lambda x, y: (x + y) / 2)
    return whole.select(*keys, F.explode(F.arrays_zip("t", total.alias("value"))).alias("x")).select(*keys, "x.t", "x.value")


# The impulse-response model's published constants.
AIR_MASS, AIR_MOLAR = 5.1352e18, 28.97e-3
MOLAR = {"CO2": 44.01e-3, "CH4": 16.043e-3, "N2O": 44.013e-3}
CARBON_FRACTIONS = [0.21787, 0.22896, 0.28454, 0.26863]
CARBON_TIMES = [1e8, 381.330, 34.7850, 4.12370]
THERMAL, THERMAL_TIMES = [0.631, 0.429], [8.400, 409.5]
EFFICIENCY = {"CO2": 1.37e-2, "CH4": 1.65 * 3.6324360e-4, "N2O": (1 - 0.36 * 1.65 * 3.63e-4 / 3.0e-3) * 3.0e-3}
PARTS = {"CO2": 1e6, "CH4": 1e9, "N2O": 1e9}
LIFETIME = {"CH4": 12.4, "N2O": 121.0}
ECS, F2X = 3.0, 3.7


@dataclass(frozen=True)
class Gas:
    """Impulse response of one gas: decay terms (fraction, time), concentration of a unit mass, efficiency, and thermal terms (scale, time)."""

    decay: tuple[tuple[float, float], ...]
    lasting: float
    concentration: float
    efficiency: float
    thermal: tuple[tuple[float, float], ...]


def gas_params(gas: str) -> Gas:
    if gas not in MOLAR:
        raise ValueError(f"unknown gas {gas!r}")
    decay, lasting = (tuple(zip(CARBON_FRACTIONS[1:], CARBON_TIMES[1:], strict=True)), CARBON_FRACTIONS[0]) if gas == "CO2" else (((1.0, LIFETIME[gas]),), 0.0)
    scale = ECS / sum(THERMAL) / F2X
    return Gas(decay, lasting, 1e12 * PARTS[gas] / MOLAR[gas] / (AIR_MASS / AIR_MOLAR), EFFICIENCY[gas], tuple((x * scale, time) for x, time in zip(THERMAL, THERMAL_TIMES, strict=True)))


#: A term of a kernel: its weight, and what is left of it after a step (1: it lasts).
Term = tuple[float, float]


def convolve(series: DataFrame, keys: list[str], terms: list[Term]) -> DataFrame:
    """keys, t, value: the sum over s <= t of F(s) times the kernel of t - s, which is a sum of terms weight * keep^lag.

    Each term is one state, carried from step to step, so the work is the steps times the terms; steps that are missing are lags like others.
    """
    lag = F.coalesce(F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t")), F.lit(0))
    columns = {f"{x}{i}": c for i, (weight, keep) in enumerate(terms) for x, c in (("k", F.pow(F.lit(keep), F.col("_lag"))), ("a", F.col("value") * weight))}
    states = scan.affine(series.select(*keys, "t", "value", lag.alias("_lag")).withColumns(columns), keys, "t", len(terms))
    return states.select(*keys, "t", sum((F.col(f"s{i}") for i in range(len(terms))), F.lit(0.0)).alias("value"))


def forcing_terms(gas: Gas) -> list[Term]:
    """The temperature that a step of forcing gives, at mid-step."""
    return [(c / time * math.exp(-0.5 / time), math.exp(-1 / time)) for c, time in gas.thermal]


def emission_terms(gas: Gas) -> list[Term]:
    """The forcing that a step of emissions gives: the change over a step of what is held."""
    scale = gas.concentration * gas.efficiency
    return [(scale * gas.lasting, 1.0), *((scale * part * time * -math.expm1(-1 / time), math.exp(-1 / time)) for part, time in gas.decay)]


def warming_terms(gas: Gas) -> list[Term]:
    """The temperature that a step of emissions gives."""
    scale, terms = gas.concentration * gas.efficiency, []
    for c, slow in gas.thermal:
        after = math.exp(-1 / slow)
        terms += [(scale * gas.lasting * c, 1.0), (-scale * gas.lasting * c * after, after)]
        for part, time in gas.decay:
            weight, own = scale * part * time * c / (time - slow), math.exp(-1 / time)
            terms += [(weight * own, own), (-weight * after, after)]
    weights: dict[float, float] = {}
    for weight, keep in terms:
        weights[keep] = weights.get(keep, 0.0) + weight
    return [(weight, keep) for keep, weight in weights.items()]


def forcing_to_temperature(series: DataFrame, keys: list[str], gas: Gas) -> DataFrame:
    return convolve(series, keys, forcing_terms(gas))


def emissions_to_forcing(series: DataFrame, keys: list[str], gas: Gas) -> DataFrame:
    return convolve(series, keys, emission_terms(gas))


def emissions_to_temperature(series: DataFrame, keys: list[str], gas: Gas) -> DataFrame:
    return convolve(series, keys, warming_terms(gas))
