"""Base valuation, greeks and scenario P&L."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.american import MIN_T, MIN_VOL, VOL_FLOOR, american_price, scenario_values
from ..functions.normal import norm_cdf, norm_pdf
from ..schema import DERIVED, GREEKS, VALUATION_INPUTS
from .scenarios import ScenarioGrid, column_of, in_long_form

MODELS = ("american", "eep")


def _require(df: DataFrame) -> None:
    missing = [c for c in VALUATION_INPUTS if c not in df.columns]
    if missing:
        raise ValueError(f"positions lack required columns: {missing}")


def years(dte: Column) -> Column:
    return F.greatest(dte, F.lit(0.0)) / F.lit(365.0)


def with_european(df: DataFrame, spot: Column, strike: Column, t: Column, rate: Column,
                  div_yield: Column, vol: Column, is_call: Column,
                  price: str = "euro_price", greeks: bool = False) -> DataFrame:
    """Append the European price, and on request the greeks, per unit.

    The expression is staged over several projections so each distribution value
    is computed once; all of them fuse into one whole-stage span.
    Vega is per volatility point, theta per calendar day, rho per basis point.
    """
    keep = df.columns
    added = [price, *(GREEKS if greeks else ())]
    df = df.withColumns({
        "__s": spot, "__k": strike, "__t": F.greatest(t, F.lit(MIN_T)),
        "__r": rate, "__q": div_yield, "__v": F.greatest(vol, F.lit(MIN_VOL)),
        "__call": is_call,
        # No volatility means intrinsic value, as for the American mark.
        "__dead": F.coalesce((t <= F.lit(MIN_T)) | (vol <= F.lit(MIN_VOL)), F.lit(True)),
    })
    s, k, tt, r, q, v = (F.col(f"__{n}") for n in "sktrqv")
    call, dead = F.col("__call"), F.col("__dead")
    df = df.withColumns({"__w": v * F.sqrt(tt), "__lm": F.ln(F.try_divide(s, k))})
    w = F.col("__w")
    df = df.withColumn("__d1", (F.col("__lm") + (r - q + v * v * F.lit(0.5)) * tt) / w)
    d1 = F.col("__d1")
    df = df.withColumns({
        "__d2": d1 - w, "__sq": s * F.exp(-q * tt), "__kr": k * F.exp(-r * tt),
        "__n1": norm_cdf(d1),
    })
    df = df.withColumn("__n2", norm_cdf(F.col("__d2")))
    n1, n2, sq, kr = (F.col(c) for c in ("__n1", "__n2", "__sq", "__kr"))
    as_call = sq * n1 - kr * n2
    live_price = F.greatest(F.when(call, as_call).otherwise(as_call - sq + kr), F.lit(0.0))
    payoff = F.greatest(F.when(call, s - k).otherwise(k - s), F.lit(0.0))
    out = {price: F.when(dead, payoff).otherwise(live_price)}
    if greeks:
        df = df.withColumn("__pdf", norm_pdf(d1))
        pdf = F.col("__pdf")
        side = F.when(call, F.lit(1.0)).otherwise(F.lit(-1.0))
        # N(side * d) without a second CDF.
        m1 = F.when(call, n1).otherwise(F.lit(1.0) - n1)
        m2 = F.when(call, n2).otherwise(F.lit(1.0) - n2)
        in_money = F.when(call, s > k).otherwise(s < k)
        zero = F.lit(0.0)
        decay = -sq * pdf * v / (F.lit(2.0) * F.sqrt(tt)) - side * (r * kr * m2 - q * sq * m1)
        out.update({
            "delta": F.when(dead, F.when(in_money, side).otherwise(zero))
                      .otherwise(side * F.exp(-q * tt) * m1),
            "gamma": F.when(dead, zero).otherwise(F.exp(-q * tt) * pdf / (s * w)),
            "vega": F.when(dead, zero).otherwise(sq * pdf * F.sqrt(tt) * F.lit(0.01)),
            "theta": F.when(dead, zero).otherwise(decay / F.lit(365.0)),
            "rho": F.when(dead, zero).otherwise(side * kr * tt * m2 * F.lit(1e-4)),
        })
    return df.withColumns(out).select(*[c for c in keep if c not in added], *added)


def _greek_columns(df: DataFrame) -> DataFrame:
    """Unit greeks: European for options, delta one for everything else."""
    option = F.coalesce(F.col("is_option"), F.lit(False))
    # A placeholder strike keeps the logarithm finite on rows without one.
    strike = F.when(option, F.col("strike")).otherwise(F.lit(1.0))
    df = with_european(
        df, F.col("underlying_price"), strike, years(F.col("dte")), F.col("rate"),
        F.col("div_yield"), F.col("iv"), F.col("is_call"), price="__euro", greeks=True,
    ).drop("__euro")
    unit = {g: F.when(option, F.col(g)).otherwise(F.lit(1.0 if g == "delta" else 0.0))
            for g in GREEKS}
    return df.withColumns(unit)


def _in_position_terms(df: DataFrame) -> DataFrame:
    notional = F.col("qty") * F.col("multiplier")
    return df.withColumns({
        "market_value": F.col("mark") * notional, "und_qty": notional,
        **{g: F.col(g) * notional for g in GREEKS},
    })


def _mark() -> Column:
    return american_price(
        F.col("underlying_price"), F.col("strike"), years(F.col("dte")), F.col("rate"),
        F.col("div_yield"), F.col("iv"), F.col("is_call"),
    )


def base_valuation(df: DataFrame) -> DataFrame:
    """Mark, market value and greeks in position terms.

    Options are marked at the American price; their greeks are European.
    """
    _require(df)
    keep = [c for c in df.columns if c not in DERIVED]
    marked = df.withColumn(
        "mark", F.when(F.col("is_option"), _mark()).otherwise(F.col("underlying_price"))
    )
    return _in_position_terms(_greek_columns(marked)).select(*keep, *DERIVED)


def early_exercise_premium(df: DataFrame, out: str = "eep") -> DataFrame:
    """American minus European value per unit, never negative; zero off options."""
    _require(df)
    option = F.coalesce(F.col("is_option"), F.lit(False))
    priced = with_european(
        df.withColumn("__amer", _mark()), F.col("underlying_price"),
        F.when(option, F.col("strike")).otherwise(F.lit(1.0)), years(F.col("dte")),
        F.col("rate"), F.col("div_yield"), F.col("iv"), F.col("is_call"), price="__euro",
    )
    gap = F.greatest(F.col("__amer") - F.col("__euro"), F.lit(0.0))
    return priced.withColumn(out, F.when(option, gap).otherwise(F.lit(0.0))).drop("__amer", "__euro")


def _matrix(df: DataFrame, grid: ScenarioGrid, horizon_days: float, model: str,
            marked: bool) -> Column:
    if model not in MODELS:
        raise ValueError(f"unknown model: {model}")
    if grid.unit == "sigma" and "sigma_daily" not in df.columns:
        raise ValueError("sigma_daily is required for a sigma grid")
    sigma = F.col("sigma_daily") if "sigma_daily" in df.columns else F.lit(0.0)
    inputs = [F.col(c) for c in ("underlying_price", "strike", "dte", "rate", "div_yield",
                                 "iv", "is_call", "qty", "multiplier", "is_option")]
    extra = [F.col("mark")] if marked else []
    return scenario_values(grid, [*inputs, sigma, *extra], horizon_days, model, marked)


def scenario_pnl(df: DataFrame, grid: ScenarioGrid, horizon_days: float = 1.0,
                 model: str = "american") -> DataFrame:
    """Append one P&L column per scenario: ``s000``, ``s001`` and so on.

    Reuses ``mark`` when the frame has been valued.  ``model="eep"`` reprices
    European and keeps today's early-exercise premium: a preview, not for reports.
    """
    _require(df)
    keep = df.columns
    values = _matrix(df, grid, horizon_days, model, "mark" in keep)
    return df.withColumn("__m", values).select(*keep, *_scenarios(grid))


def _scenarios(grid: ScenarioGrid) -> list[Column]:
    return [F.expr(f"__m[{i + 1}] AS {column_of(i)}") for i in range(len(grid))]


def value_batch(df: DataFrame, grid: ScenarioGrid, horizon_days: float = 1.0,
                model: str = "american") -> DataFrame:
    """Base valuation and scenario columns in one pass over the book.

    One Arrow UDF yields mark and matrix together; greeks stay in the JVM.
    """
    _require(df)
    keep = [c for c in df.columns if c not in DERIVED]
    priced = df.select(*keep).withColumn("__m", _matrix(df, grid, horizon_days, model, False))
    priced = priced.withColumn("mark", F.col("__m")[0])
    priced = _in_position_terms(_greek_columns(priced))
    return priced.select(*keep, *DERIVED, *_scenarios(grid))


def european_pnl_long(df: DataFrame, grid: ScenarioGrid, horizon_days: float = 1.0) -> DataFrame:
    """What-if P&L, one row per position and scenario, at European prices.

    All native: suited to ad-hoc questions where the wide matrix is not wanted.
    Columns added: ``sid label shock vol_shift days move pnl``.
    """
    _require(df)
    keep = df.columns
    option = F.coalesce(F.col("is_option"), F.lit(False))
    strike = F.when(option, F.col("strike")).otherwise(F.lit(1.0))
    shared = (strike, F.col("rate"), F.col("div_yield"), F.col("is_call"))

    def price(frame, spot, t, vol, name):
        k, r, q, c = shared
        return with_european(frame, spot, k, t, r, q, vol, c, price=name)

    spot = F.col("underlying_price")
    based = price(df, spot, years(F.col("dte")), F.col("iv"), "__base")
    long = in_long_form(based, grid, horizon_days)
    shocked = spot * (F.lit(1.0) + F.col("move"))
    left = years(F.greatest(F.col("dte"), F.lit(0.0)) - F.col("days"))
    vol = F.greatest(F.col("iv") + F.col("vol_shift"), F.lit(VOL_FLOOR))
    long = price(long, shocked, left, vol, "__new")
    unit = F.when(option, F.col("__new") - F.col("__base")).otherwise(shocked - spot)
    return long.withColumn("pnl", unit * F.col("qty") * F.col("multiplier")).select(
        *keep, "sid", "label", "shock", "vol_shift", "days", "move", "pnl"
    )
