"""Pricing against scalar textbook formulas and no-arbitrage properties."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.functions.american import np_american, np_european, reprice
from tremor.functions.normal import norm_cdf, np_norm_cdf
from tremor.operators.valuation import with_european


def N(x):
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def euro(s, k, t, r, q, v, call):
    if t <= 1e-8 or v <= 1e-8:
        return max(s - k if call else k - s, 0.0)
    d1 = (math.log(s / k) + (r - q + v * v / 2) * t) / (v * math.sqrt(t))
    d2 = d1 - v * math.sqrt(t)
    c = s * math.exp(-q * t) * N(d1) - k * math.exp(-r * t) * N(d2)
    return max(c if call else c - s * math.exp(-q * t) + k * math.exp(-r * t), 0.0)


def bs93(s, k, t, r, b, v):
    """Bjerksund-Stensland 1993 call, written term by term."""
    v2 = v * v
    beta = 0.5 - b / v2 + math.sqrt((b / v2 - 0.5) ** 2 + 2 * r / v2)
    top, base = beta / (beta - 1) * k, max(k, r / (r - b) * k)
    h = -(b * t + 2 * v * math.sqrt(t)) * base / (top - base)
    x = base + (top - base) * (1 - math.exp(h))
    if s >= x:
        return s - k

    def phi(g, barrier):
        d = -(math.log(s / barrier) + (b + (g - 0.5) * v2) * t) / (v * math.sqrt(t))
        kappa = 2 * b / v2 + 2 * g - 1
        lam = (-r + g * b + 0.5 * g * (g - 1) * v2) * t
        far = N(d - 2 * math.log(x / s) / (v * math.sqrt(t)))
        return math.exp(lam) * s ** g * (N(d) - (x / s) ** kappa * far)

    a = (x - k) * x ** -beta
    return (a * s ** beta - a * phi(beta, x) + phi(1, x) - phi(1, k) - k * phi(0, x) + k * phi(0, k))


def american(s, k, t, r, q, v, call):
    intrinsic = max(s - k if call else k - s, 0.0)
    if t <= 1e-8 or v <= 1e-8:
        return intrinsic
    value = euro(s, k, t, r, q, v, call)
    b = r - q
    args = (s, k, t, r, b, v) if call else (k, s, t, r - b, -b, v)
    if args[4] < args[3]:
        value = max(value, bs93(*args))
    return max(value, intrinsic)


def draws(n, seed=11):
    g = np.random.default_rng(seed)
    s = g.uniform(5, 500, n)
    return (s, s * g.uniform(0.5, 1.5, n), g.uniform(0.01, 3, n), g.uniform(0.001, 0.08, n),
            g.uniform(0, 0.05, n), g.uniform(0.05, 1.2, n), g.random(n) < 0.5)


def test_normal_cdf_matches_erfc(spark):
    x = np.linspace(-40, 40, 20_001)
    exact = np.array([N(v) for v in x])
    assert np.abs(np_norm_cdf(x) - exact).max() < 1e-15
    frame = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = frame.select("x", norm_cdf(F.col("x")).alias("n")).toPandas().sort_values("x")
    assert np.abs(out["n"].to_numpy() - exact).max() < 1e-15


def test_textbook_prices():
    a = [np.array([z]) for z in (42.0, 40.0, 0.5, 0.10, 0.0, 0.20)]
    assert np_european(*a, np.array([True]))[0] == pytest.approx(4.76, abs=0.005)
    assert np_european(*a, np.array([False]))[0] == pytest.approx(0.81, abs=0.005)


def test_kernel_matches_scalar_reference():
    d = draws(4000)
    rows = list(zip(*d))
    assert np.abs(np_american(*d) - [american(*r) for r in rows]).max() < 1e-8
    assert np.abs(np_european(*d) - [euro(*r) for r in rows]).max() < 1e-10


def test_american_bounds():
    s, k, t, r, q, v, c = d = draws(5000, 3)
    price = np_american(*d)
    assert np.isfinite(price).all()
    assert (price >= np_european(*d) - 1e-9).all()
    assert (price >= np.maximum(np.where(c, s - k, k - s), 0) - 1e-9).all()


def test_american_call_without_yield_is_european():
    s, k, t, r, q, v, c = draws(2000, 5)
    d = (s, k, t, r, np.zeros_like(q), v, np.ones_like(c))
    assert np.abs(np_american(*d) - np_european(*d)).max() < 1e-10


def test_put_premium_grows_with_moneyness():
    s = np.array([120.0, 105.0, 100.0, 85.0, 70.0])
    full = [np.full(5, z) for z in (100.0, 0.5, 0.05, 0.0, 0.3)]
    d = (s, *full, np.zeros(5, dtype=bool))
    assert (np.diff(np_american(*d) - np_european(*d)) > 0).all()


def test_expired_and_degenerate_inputs():
    one = lambda *x: [np.array([float(z)]) for z in x]
    assert np_american(*one(42, 40, 0, .1, 0, .2), np.array([True]))[0] == 2.0
    assert np_american(*one(38, 40, 0, .1, 0, .2), np.array([False]))[0] == 2.0
    assert np_american(*one(42, 40, 1, .1, 0, 0), np.array([True]))[0] == 2.0
    missing = np_american(*one(42, 40, 1, .1, 0, float("nan")), np.array([True]))[0]
    assert missing == 2.0  # no volatility: intrinsic


@settings(max_examples=60, deadline=None)
@given(st.floats(20, 400), st.floats(0.6, 1.5), st.floats(0.02, 2), st.floats(0.0, 0.08),
       st.floats(0.0, 0.06), st.floats(0.08, 0.9), st.booleans())
def test_scenario_grid_equals_single_prices(s, m, t, r, q, v, call):
    """Sharing work between scenarios changes no price."""
    spots = s * np.array([[0.8, 0.9, 1.0, 1.1]])
    vols, times = np.array([[v, v + 0.1]]), np.array([[t, t]])
    pick = np.array([0, 1, 0, 1])
    row = [np.array([z]) for z in (s * m, r, q)]
    grid = reprice(spots, *row, np.array([call]), vols, times, pick)[0]
    for j in range(4):
        each = np_american(spots[0, j:j + 1], row[0], times[0, :1], row[1], row[2],
                           vols[0, pick[j]:pick[j] + 1], np.array([call]))[0]
        assert grid[j] == pytest.approx(each, rel=1e-12, abs=1e-12)


def _native(spark, d, greeks=True):
    names = ["s", "k", "t", "r", "q", "v", "c"]
    frame = spark.createDataFrame(pd.DataFrame(dict(zip(names, d))).assign(i=range(len(d[0]))))
    out = with_european(frame, *[F.col(x) for x in names], greeks=greeks)
    return out.toPandas().sort_values("i", ignore_index=True)


def test_native_prices_parity_and_greeks(spark):
    d = draws(2000, 8)
    s, k, t, r, q, v, c = d
    out = _native(spark, d)
    assert np.abs(out["euro_price"] - [euro(*x) for x in zip(*d)]).max() < 1e-10
    calls = np_european(s, k, t, r, q, v, np.ones_like(c))
    puts = np_european(s, k, t, r, q, v, np.zeros_like(c))
    assert np.abs(calls - puts - (s * np.exp(-q * t) - k * np.exp(-r * t))).max() < 1e-9

    def bumped(i, h):
        up, down = list(d), list(d)
        up[i], down[i] = d[i] + h, d[i] - h
        return (np_european(*up) - np_european(*down)) / (2 * h)

    live = t > 0.05
    assert np.allclose(out["delta"][live], bumped(0, 1e-4 * s)[live], atol=1e-4)
    assert np.allclose(out["vega"][live], 0.01 * bumped(5, 1e-5)[live], atol=1e-4)
    assert np.allclose(out["rho"][live], 1e-4 * bumped(3, 1e-6)[live], atol=1e-4)
    assert np.allclose(out["theta"][live], -bumped(2, 1e-6)[live] / 365, atol=1e-4)
    up, down = list(d), list(d)
    up[0], down[0] = s * 1.001, s * 0.999
    gamma = (np_european(*up) - 2 * np_european(*d) + np_european(*down)) / (s * 0.001) ** 2
    assert np.allclose(out["gamma"][live], gamma[live], rtol=2e-2, atol=1e-4)


def test_native_greeks_of_expired_options(spark):
    d = [np.array(x) for x in ([42.0, 38, 42, 38], [40.0] * 4, [0.0] * 4, [.1] * 4, [0.0] * 4,
                               [.2] * 4, [True, True, False, False])]
    out = _native(spark, d)
    assert list(out["euro_price"]) == [2, 0, 0, 2]
    assert list(out["delta"]) == [1, 0, 0, -1]
    assert (out[["gamma", "vega", "theta", "rho"]] == 0).all().all()
