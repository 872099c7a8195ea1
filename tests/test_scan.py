"""Affine recurrences as scans, and the responses built on them."""

import math

import numpy as np
import pytest

from plumbline.operators import response, scan


@pytest.mark.parametrize("block", [3, 256])
def test_affine(spark, block):
    rng = np.random.default_rng(1)
    rows = [(k, t, *map(float, rng.uniform(-1, 1, 4))) for k, n in (("a", 40), (None, 7), ("c", 1)) for t in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, k0 double, a0 double, k1 double, a1 double")
    got = {(r.k, r.t): (r.s0, r.s1) for r in scan.affine(df, ["k"], "t", 2, block).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, t, k0, a0, k1, a1 in rows:
        s = state.get(k, (0.0, 0.0))
        state[k] = (s[0] * k0 + a0, s[1] * k1 + a1)
        assert np.allclose(got[k, t], state[k], rtol=1e-12, atol=1e-14)
    assert scan.affine(df.limit(0), ["k"], "t", 2).collect() == []


def kernel(gas, of):
    held = lambda n: gas.concentration * gas.efficiency * (gas.lasting * n + sum(p * t * (1 - math.exp(-n / t)) for p, t in gas.decay))
    if of is response.forcing_to_temperature:
        return lambda lag: sum(c / t * math.exp(-(lag + 0.5) / t) for c, t in gas.thermal)
    if of is response.emissions_to_forcing:
        return lambda lag: held(lag + 1) - held(lag)

    def warming(lag):
        n, out = lag + 1, 0.0
        for c, slow in gas.thermal:
            out += gas.lasting * c * (1 - math.exp(-n / slow))
            out += sum(p * t * c * (math.exp(-n / t) - math.exp(-n / slow)) / (t - slow) for p, t in gas.decay)
        return gas.concentration * gas.efficiency * out

    return warming


@pytest.mark.parametrize("gas", ["CO2", "CH4", "N2O"])
def test_convolutions(spark, gas, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 8)
    rng, g = np.random.default_rng(2), response.gas_params(gas)
    steps = {"whole": list(range(1850, 1880)), "gaps": [0, 1, 5, 6, 30]}
    values = {k: rng.normal(size=len(s)) for k, s in steps.items()}
    df = spark.createDataFrame([(k, t, float(v)) for k in steps for t, v in zip(steps[k], values[k], strict=True)], "k string, t long, value double")
    for of in (response.forcing_to_temperature, response.emissions_to_forcing, response.emissions_to_temperature):
        k = kernel(g, of)
        got = {(r.k, r.t): r.value for r in of(df, ["k"], g).collect()}
        for name, at in steps.items():
            for i, t in enumerate(at):
                assert math.isclose(got[name, t], sum(f * k(t - s) for s, f in zip(at[: i + 1], values[name], strict=False)), rel_tol=1e-9, abs_tol=1e-12)
    with pytest.raises(ValueError):
        response.gas_params("else")


@pytest.mark.parametrize("midpoint", [False, True])
def test_boxes_over_blocks(spark, midpoint, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 5)
    rng = np.random.default_rng(3)
    forcing = {(v, e): rng.normal(size=23 if e == "e1" else 4) for v in ("GHG", "Nat") for e in ("e1", "e2")}
    boxes = {"A": [(1.5, 0.3), (40.0, 0.5)], "B": [(0.2, 1.0)], "C": [(3.0, 0.1), (20.0, 0.2), (300.0, 0.4)]}
    f = spark.createDataFrame([(v, e, t, float(x)) for (v, e), s in forcing.items() for t, x in enumerate(s)], "variable string, ensemble string, t long, value double")
    p = spark.createDataFrame([(m, i, d, q) for m, own in boxes.items() for i, (d, q) in enumerate(own)], "model string, box int, d double, q double")
    got = {(r.model, r.ensemble, r.variable, r.t): r.value for r in response.box_response(f, p, midpoint).collect()}
    assert len(got) == len(boxes) * sum(map(len, forcing.values()))
    for m, own in boxes.items():
        for (v, e), s in forcing.items():
            state = np.zeros(len(own))
            for t, x in enumerate(s):
                before = state
                state = np.array([b * math.exp(-1 / d) + q * x * (1 - math.exp(-1 / d)) for b, (d, q) in zip(before, own, strict=True)])
                assert math.isclose(got[m, e, v, t], (state + before).sum() / 2 if midpoint else state.sum(), rel_tol=1e-10, abs_tol=1e-13)
