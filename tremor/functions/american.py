"""American option prices as Arrow UDFs.

Bjerksund and Stensland (1993), "Closed-form approximation of American options".
The price of a call is homogeneous in spot and strike, and a put is the call
with both swapped and (r, b) replaced by (r - b, -b).  So every option is priced
as a unit-strike call on the ratio spot/strike:

* the exercise boundary depends only on the shocked volatility and time, so it
  is computed once per volatility level instead of once per scenario;
* the European price needs no distribution value that the American one does not
  already use, so one reprice takes ten normal CDFs.

Rows arrive in Arrow batches that Spark partitions; the kernel walks them in
blocks small enough to stay in cache.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal import np_norm_cdf

# Below these an option counts as expired and is worth its intrinsic value.
MIN_T = 1e-8
MIN_VOL = 1e-8
# Floor of a shocked volatility.
VOL_FLOOR = 0.001
# Elements per block: about a dozen live arrays of 128 KB each.
BLOCK = 16_384


@dataclass
class _Carry:
    """Per (row, volatility level) terms of a unit-strike call."""

    drift1: np.ndarray  # (b + vol^2/2) T
    drift0: np.ndarray  # (b - vol^2/2) T
    width: np.ndarray  # vol sqrt(T)
    grow: np.ndarray  # exp((b - r) T)
    fade: np.ndarray  # exp(-r T)
    live: np.ndarray


def _carry(r, b, vol, t) -> _Carry:
    half = 0.5 * vol * vol
    return _Carry(
        drift1=(b + half) * t, drift0=(b - half) * t, width=vol * np.sqrt(t),
        grow=np.exp((b - r) * t), fade=np.exp(-r * t),
        live=(t > MIN_T) & (vol > MIN_VOL),
    )


def _boundary(r, b, vol, t):
    """Exponent and flat exercise boundary of a unit-strike call."""
    v2 = vol * vol
    tilt = b / v2 - 0.5
    beta = np.sqrt(tilt * tilt + 2.0 * r / v2) - tilt
    perpetual = beta / (beta - 1.0)
    immediate = np.maximum(1.0, r / np.maximum(r - b, 1e-12))
    gap = perpetual - immediate
    safe = np.where(np.abs(gap) < 1e-12, 1e-12, gap)
    speed = (b * t + 2.0 * vol * np.sqrt(t)) * immediate / safe
    trigger = np.maximum(immediate + gap * (1.0 - np.exp(-speed)), 1.0 + 1e-9)
    return beta, trigger


def _settle(price, payoff, live, american):
    """Expired options are worth their payoff, American ones never less than it.

    An approximation that is not finite counts as zero.
    """
    if american:
        price = np.maximum(np.where(np.isfinite(price), price, 0.0), payoff)
    return np.where(live, price, payoff)


def _european_unit(m, c: _Carry, pick):
    log_m = np.log(m)
    width = c.width[:, pick]
    n1 = np_norm_cdf((log_m + c.drift1[:, pick]) / width)
    n0 = np_norm_cdf((log_m + c.drift0[:, pick]) / width)
    return np.maximum(m * c.grow[:, pick] * n1 - c.fade[:, pick] * n0, 0.0)


def _american_unit(m, r, b, vol, t, c: _Carry, pick):
    beta, trigger = _boundary(r, b, vol, t)
    log_x = np.log(trigger)
    alpha = (trigger - 1.0) * np.exp(-beta * log_x)
    drift_b = (b + (beta - 0.5) * vol * vol) * t
    kappa0 = 2.0 * b / (vol * vol) - 1.0
    kappa_b = kappa0 + 2.0 * beta

    log_m = np.log(m)
    inv = (1.0 / c.width)[:, pick]
    gap = log_x[:, pick] - log_m
    gap_w = gap * inv
    far0 = np.exp(kappa0[:, pick] * gap)
    ratio = trigger[:, pick] / m
    far1 = far0 * ratio * ratio

    # gamma = beta, barrier at the trigger; its discount exponent is zero.
    d = drift_b[:, pick] * inv
    term = np_norm_cdf(gap_w - d)
    term -= np.exp(kappa_b[:, pick] * gap) * np_norm_cdf(-gap_w - d)
    value = alpha[:, pick] * np.exp(beta[:, pick] * log_m) * (1.0 - term)

    # gamma = 1: barrier at the trigger minus barrier at the strike.
    d = c.drift1[:, pick] * inv
    strike_d = log_m * inv + d
    below1 = np_norm_cdf(-strike_d)
    term = np_norm_cdf(gap_w - d) - below1
    term -= far1 * (np_norm_cdf(-gap_w - d) - np_norm_cdf(-strike_d - 2.0 * gap_w))
    grown = c.grow[:, pick] * m
    value += grown * term

    # gamma = 0: the same pair with the opposite sign.
    d = c.drift0[:, pick] * inv
    strike_d = log_m * inv + d
    below0 = np_norm_cdf(-strike_d)
    term = np_norm_cdf(gap_w - d) - below0
    term -= far0 * (np_norm_cdf(-gap_w - d) - np_norm_cdf(-strike_d - 2.0 * gap_w))
    faded = c.fade[:, pick]
    value -= faded * term

    value = np.where(m >= trigger[:, pick], m - 1.0, value)
    european = np.maximum(grown * (1.0 - below1) - faded * (1.0 - below0), 0.0)
    return np.maximum(value, european)


def reprice(spot, strike, rate, div_yield, is_call, vol, t, pick, american=True):
    """Prices of shape (rows, scenarios).

    ``spot`` is (rows, scenarios); ``vol`` and ``t`` are (rows, levels) and
    ``pick[s]`` is the level of scenario ``s``; the rest is per row.
    """
    rows, scenarios = spot.shape
    out = np.empty((rows, scenarios))
    call = is_call.astype(bool)
    # Early exercise is worth something for calls with a yield and puts with a rate.
    early = np.where(call, div_yield > 0.0, rate > 0.0) & american
    step = max(1, BLOCK // max(1, scenarios))
    with np.errstate(all="ignore"):
        for wants_early in (True, False):
            chosen = np.flatnonzero(early == wants_early)
            for start in range(0, len(chosen), step):
                idx = chosen[start:start + step]
                call_i = call[idx][:, None]
                s, k = spot[idx], strike[idx][:, None]
                r, q = rate[idx][:, None], div_yield[idx][:, None]
                v, tt = vol[idx], t[idx]
                m = np.where(call_i, s / k, k / s)
                unit = np.where(call_i, k, s)
                r_star = np.where(call_i, r, q)
                b_star = np.where(call_i, r - q, q - r)
                c = _carry(r_star, b_star, v, tt)
                if wants_early:
                    price = _american_unit(m, r_star, b_star, v, tt, c, pick)
                else:
                    price = _european_unit(m, c, pick)
                payoff = np.maximum(np.where(call_i, s - k, k - s), 0.0)
                out[idx] = _settle(unit * price, payoff, c.live[:, pick], american)
    return out


def np_american(spot, strike, t, rate, div_yield, vol, is_call) -> np.ndarray:
    """American prices of equal-length arrays."""
    return _single(spot, strike, t, rate, div_yield, vol, is_call, True)


def np_european(spot, strike, t, rate, div_yield, vol, is_call) -> np.ndarray:
    return _single(spot, strike, t, rate, div_yield, vol, is_call, False)


def _single(spot, strike, t, rate, div_yield, vol, is_call, american):
    return reprice(
        spot[:, None], strike, rate, div_yield, is_call, vol[:, None], t[:, None],
        np.zeros(1, dtype=np.int64), american,
    )[:, 0]


def _doubles(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _flags(a: pa.Array) -> np.ndarray:
    return a.fill_null(False).to_numpy(zero_copy_only=False).astype(bool, copy=False)


def american_price(spot, strike, t, rate, div_yield, vol, is_call) -> Column:
    """American price per row; arguments are Columns, ``t`` in years."""

    def price(s: pa.Array, k: pa.Array, y: pa.Array, r: pa.Array, q: pa.Array,
              v: pa.Array, c: pa.Array) -> pa.Array:
        return pa.array(np_american(
            *(_doubles(a) for a in (s, k, y, r, q, v)), _flags(c)))

    return F.arrow_udf(price, "double")(spot, strike, t, rate, div_yield, vol, is_call)


def scenario_values(grid, columns, horizon_days: float, model: str, marked: bool) -> Column:
    """``array<double>``: the base mark, then one P&L per scenario of ``grid``.

    ``columns`` are the valuation inputs, then the daily deviation, then the
    mark when ``marked``.  One UDF call carries a row's whole matrix, so the plan
    has a single Python exchange and text columns never leave the JVM.
    """
    under = np.array([p.underlying for p in grid.points])
    vols = np.array([p.vol for p in grid.points])
    days = np.array([p.days for p in grid.points])
    levels, pick = np.unique(np.stack([vols, days]), axis=1, return_inverse=True)
    pick = pick.reshape(-1)
    sigma_unit = grid.unit == "sigma"
    scale = float(np.sqrt(horizon_days))
    width = len(grid.points) + 1
    american = model == "american"

    def matrix(*arrays: pa.Array) -> pa.Array:
        spot, strike, dte, rate, div_yield, iv = (_doubles(a) for a in arrays[:6])
        is_call, option = _flags(arrays[6]), _flags(arrays[9])
        notional = _doubles(arrays[7]) * _doubles(arrays[8])
        sigma = _doubles(arrays[10])
        rows = len(spot)
        out = np.empty((rows, width))
        if sigma_unit:
            moves = (sigma * scale)[:, None] * under
        else:
            moves = np.broadcast_to(under, (rows, len(under)))
        shocked = spot[:, None] * (1.0 + moves)
        out[:, 0] = spot
        np.subtract(shocked, spot[:, None], out=out[:, 1:])
        o = np.flatnonzero(option)
        if len(o):
            args = (strike[o], rate[o], div_yield[o], is_call[o])
            life = np.maximum(dte[o], 0.0)
            years, own_vol = life / 365.0, iv[o]
            one = np.zeros(1, dtype=np.int64)

            def base(american_style):
                return reprice(spot[o][:, None], *args, own_vol[:, None],
                               years[:, None], one, american_style)[:, 0]

            mark = _doubles(arrays[11])[o] if marked else base(True)
            vol = np.maximum(own_vol[:, None] + levels[0], VOL_FLOOR)
            t = np.maximum(life[:, None] - levels[1], 0.0) / 365.0
            price = reprice(shocked[o], *args, vol, t, pick, american)
            if not american:
                price += np.maximum(base(True) - base(False), 0.0)[:, None]
            out[o, 0] = mark
            out[o, 1:] = price - mark[:, None]
        out[:, 1:] *= notional[:, None]
        offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)))

    return F.arrow_udf(matrix, "array<double>")(*columns)
