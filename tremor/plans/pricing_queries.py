"""Registered queries on pricing, scenarios and listed-contract helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.american import VOL_FLOOR, american_price
from ..functions.listed import listed_expiry, strike_step, third_friday
from ..functions.normal import norm_cdf, norm_pdf
from ..operators.scenarios import column_of, daily_sigma, in_long_form
from ..operators.valuation import (base_valuation, early_exercise_premium, european_pnl_long,
                                   scenario_pnl, with_european, years)
from . import sql as Q
from .book import GRID, book, table
from .common import rounded

OPTION_INPUTS = ("underlying_price", "strike", "rate", "div_yield", "iv", "is_call")


def q_norm_cdf(spark, d):
    b = book(spark, d).where("is_option").select(
        "position_id", (F.ln(F.col("underlying_price") / F.col("strike")) / (F.col("iv") / 10)).alias("x"))
    return rounded(b.select("position_id", norm_cdf(F.col("x")).alias("cdf"),
                            norm_pdf(F.col("x")).alias("pdf")), 10)


S_NORM_CDF = Q.with_book(f"""
SELECT position_id, {Q.rounded(Q.cdf('x'), 10, 'cdf')}, {Q.rounded(Q.pdf('x'), 10, 'pdf')}
FROM (SELECT position_id, ln(underlying_price / strike) / (iv / 10) AS x FROM book WHERE is_option)""")


def _european(spark, d, greeks):
    b = book(spark, d).where("is_option")
    s, k, r, q, v, c = (F.col(x) for x in OPTION_INPUTS)
    return with_european(b, s, k, years(F.col("dte")), r, q, v, c, greeks=greeks)


def q_bs_price(spark, d):
    return rounded(_european(spark, d, False).select("position_id", "euro_price"), 6)


_EURO_ONLY = ",".join([Q.BOOK, Q.BASE_LEGS, Q.european("legs", "euros")])
S_BS_PRICE = f"WITH {_EURO_ONLY} SELECT position_id, {Q.rounded('euro', 6, 'euro_price')} FROM euros"


def q_bs_greeks(spark, d):
    return rounded(_european(spark, d, True).select(
        "position_id", "delta", "gamma", "vega", "theta", "rho"), 7)


S_BS_GREEKS = (f"WITH {_EURO_ONLY}, {Q.GREEKS_SQL} SELECT position_id, "
               f"{Q.rounded_list(Q.GREEKS, 7)} FROM greeks")


def q_american_price(spark, d):
    b = book(spark, d).where("is_option")
    s, k, r, q, v, c = (F.col(x) for x in OPTION_INPUTS)
    return rounded(b.select(
        "position_id", american_price(s, k, years(F.col("dte")), r, q, v, c).alias("price")), 4)


_AMER = ",".join([Q.BOOK, Q.BASE_LEGS, Q.european("legs", "euros"), Q.american("euros", "amers")])
S_AMERICAN_PRICE = f"WITH {_AMER} SELECT position_id, {Q.rounded('amer', 4, 'price')} FROM amers"

VALUED_COLUMNS = ("mark", *Q.MEASURES)


def q_base_valuation(spark, d):
    return rounded(base_valuation(book(spark, d)).select("position_id", *VALUED_COLUMNS))


S_BASE_VALUATION = Q.with_valued(
    f"SELECT position_id, {Q.rounded_list(VALUED_COLUMNS)} FROM valued")


def q_early_exercise_premium(spark, d):
    return rounded(early_exercise_premium(book(spark, d)).select("position_id", "eep"), 4)


S_EARLY_EXERCISE = f"""WITH {_AMER}
SELECT b.position_id, round(coalesce(greatest(amer - euro, 0), 0), 4) + 0::DOUBLE AS eep
FROM book b LEFT JOIN amers a USING (position_id)"""


def q_shock_axis(spark, d):
    """Exposure to every point of the price axis: market move times delta-one size."""
    b = in_long_form(book(spark, d), GRID)
    return rounded(b.groupBy("shock").agg(
        F.count(F.lit(1)).alias("positions"),
        F.sum(F.col("move") * F.col("underlying_price") * F.col("qty")).alias("exposure")), 0)


S_SHOCK_AXIS = f"""WITH {Q.BOOK}, {Q.SHOCKS}
SELECT shock, count(*) AS positions,
  round(sum(sigma_daily * shock * underlying_price * qty), 0) + 0::DOUBLE AS exposure
FROM book CROSS JOIN shocks GROUP BY shock"""


def q_scenario_grid(spark, d):
    """Every scenario of the grid with the size and volatility it lands on."""
    b = in_long_form(book(spark, d), GRID)
    shocked = F.greatest(F.col("iv") + F.col("vol_shift"), F.lit(VOL_FLOOR))
    g = b.groupBy("sid", "label", "shock", "vol_shift", "days").agg(
        F.count(F.lit(1)).alias("positions"),
        F.avg(F.when(F.col("is_option"), shocked)).alias("mean_vol"),
        F.max("move").alias("largest_move"))
    return rounded(g, 6)


S_SCENARIO_GRID = f"""WITH {Q.BOOK}, {Q.SHOCKS}
SELECT sid::BIGINT AS sid, label, shock, vol_shift, days, count(*) AS positions,
  round(avg(CASE WHEN is_option THEN greatest(iv + vol_shift, 0.001) END), 6) AS mean_vol,
  round(max(sigma_daily * shock), 6) + 0::DOUBLE AS largest_move
FROM book CROSS JOIN shocks GROUP BY ALL"""


def q_resolve_moves(spark, d):
    b = in_long_form(book(spark, d), GRID, horizon_days=4.0)
    return rounded(b.groupBy("desk", "sid").agg(
        F.min("move").alias("least"), F.avg("move").alias("mean"), F.max("move").alias("most")), 8)


S_RESOLVE_MOVES = f"""WITH {Q.BOOK}, {Q.SHOCKS}, m AS (
  SELECT desk, sid, sigma_daily * sqrt(4) * shock AS move FROM book CROSS JOIN shocks)
SELECT desk, sid::BIGINT AS sid, round(min(move), 8) + 0::DOUBLE AS least,
  round(avg(move), 8) + 0::DOUBLE AS mean, round(max(move), 8) + 0::DOUBLE AS most
FROM m GROUP BY desk, sid"""


def q_scenario_lookup(spark, d):
    """The scenario at minus two deviations and flat volatility, by coordinates."""
    column = column_of(GRID.index_of(-2.0, 0.0))
    p = scenario_pnl(book(spark, d), GRID)
    return rounded(p.groupBy("sector").agg(F.sum(column).alias("pnl")), 0)


S_SCENARIO_LOOKUP = Q.with_batch(
    "SELECT sector, round(sum(s002), 0) + 0::DOUBLE AS pnl FROM batch GROUP BY sector")


def q_daily_sigma(spark, d):
    """Deviation of daily log returns of each user's mean event value."""
    prices = (
        table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.avg("value").alias("price"))
    )
    return rounded(daily_sigma(prices, "user_id", "day", "price"), 8)


S_DAILY_SIGMA = """WITH p AS (
  SELECT user_id, ts::DATE AS day, avg(value) AS price FROM events GROUP BY 1, 2),
r AS (SELECT user_id, ln(price / lag(price) OVER (PARTITION BY user_id ORDER BY day)) AS ret FROM p)
SELECT user_id, count(ret) AS returns, round(stddev_samp(ret), 8) AS sigma_daily,
  round(stddev_samp(ret) * sqrt(252.0), 8) AS sigma_annual FROM r GROUP BY user_id"""


def q_scenario_pnl_equity(spark, d):
    b = book(spark, d).where("NOT is_option")
    return rounded(scenario_pnl(b, GRID).select("position_id", *Q.SCENARIOS), 5)


S_PNL_EQUITY = f"""WITH {Q.BOOK}, {Q.SHOCKS}, pnl AS (
  SELECT position_id, sid, (underlying_price * (1 + sigma_daily * shock) - underlying_price)
    * (qty * multiplier) AS pnl FROM book CROSS JOIN shocks WHERE NOT is_option)
SELECT position_id, {', '.join(
    f'round(max(CASE WHEN sid = {i} THEN pnl END), 5) + 0::DOUBLE AS {s}' for i, s in enumerate(Q.SCENARIOS))}
FROM pnl GROUP BY position_id"""


def q_scenario_pnl_euro(spark, d):
    long = european_pnl_long(book(spark, d), GRID)
    return rounded(long.groupBy("sector", "sid", "label").agg(F.sum("pnl").alias("pnl")), 0)


S_PNL_EURO = f"""WITH {Q.BOOK}, {Q.SHOCKS}, {Q.SHOCKED_LEGS}, {Q.european('legs', 'euros')}, pnl AS (
  SELECT e.position_id, e.sid, e.euro - m.euro AS unit FROM euros e
  JOIN euros m ON e.position_id = m.position_id AND m.sid = -1 WHERE e.sid >= 0
  UNION ALL SELECT position_id, sid, underlying_price * sigma_daily * shock
  FROM book CROSS JOIN shocks WHERE NOT is_option)
SELECT sector, p.sid::BIGINT AS sid, label, round(sum(unit * qty * multiplier), 0) + 0::DOUBLE AS pnl
FROM pnl p JOIN book USING (position_id) JOIN shocks ON shocks.sid = p.sid GROUP BY ALL"""


def q_scenario_pnl_american(spark, d):
    return rounded(scenario_pnl(book(spark, d), GRID).select("position_id", *Q.SCENARIOS))


S_PNL_AMERICAN = Q.with_batch(f"SELECT position_id, {Q.rounded_list(Q.SCENARIOS)} FROM batch")


def q_scenario_pnl_eep(spark, d):
    p = scenario_pnl(book(spark, d), GRID, model="eep")
    return rounded(p.groupBy("sector").agg(*[F.sum(s).alias(s) for s in Q.SCENARIOS]))


S_PNL_EEP = f"""WITH {Q.BOOK}, {Q.SHOCKS}, {Q.SHOCKED_LEGS}, {Q.european('legs', 'euros')},
base AS (SELECT * FROM euros WHERE sid = -1), {Q.american('base', 'amers')}, pnl AS (
  SELECT e.position_id, e.sid, e.euro + greatest(m.amer - m.euro, 0) - m.amer AS unit
  FROM euros e JOIN amers m ON e.position_id = m.position_id WHERE e.sid >= 0
  UNION ALL SELECT position_id, sid, underlying_price * sigma_daily * shock
  FROM book CROSS JOIN shocks WHERE NOT is_option)
SELECT sector, {', '.join(
    f'round(sum(CASE WHEN sid = {i} THEN unit * qty * multiplier END), 0) + 0::DOUBLE AS {s}'
    for i, s in enumerate(Q.SCENARIOS))}
FROM pnl JOIN book USING (position_id) GROUP BY sector"""


def q_third_friday(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    text = F.date_format(third_friday(F.col("day")), "yyyy-MM-dd").alias("expiry")
    return o.groupBy("day").agg(F.count(F.lit(1)).alias("orders")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "orders", text)


def _friday(day: str) -> str:
    return f"({day} + ((12 - isodow({day})) % 7)::INTEGER)"


def _third(day: str) -> str:
    first = f"date_trunc('month', {day})::DATE"
    return f"({_friday(first)} + 14)"


S_THIRD_FRIDAY = f"""WITH o AS (SELECT o_orderdate::DATE AS day, count(*) AS orders FROM orders GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, orders, strftime({_third('day')}, '%Y-%m-%d') AS expiry FROM o"""


def q_listed_expiry(spark, d):
    """Each order line's tenor snapped to a listed date."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    tenor = F.abs(F.datediff("l_shipdate", "o_orderdate")) % 365
    e = j.select(F.to_date("o_orderdate").alias("today"), tenor.alias("tenor")).select(
        F.date_format(listed_expiry(F.col("today"), F.col("tenor")), "yyyy-MM-dd").alias("expiry"),
        F.when(F.col("tenor") < 30, "weekly").otherwise("monthly").alias("line"))
    return e.groupBy("expiry", "line").agg(F.count(F.lit(1)).alias("contracts"))


S_LISTED_EXPIRY = f"""WITH j AS (
  SELECT o_orderdate::DATE AS today,
    (abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 365)::INTEGER AS tenor
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, today + tenor AS target FROM j),
s AS (SELECT *, {_friday('target')} AS week, {_third('target')} AS month,
  {_third("(date_trunc('month', target) + INTERVAL 1 MONTH)::DATE")} AS after FROM t),
e AS (SELECT CASE WHEN tenor < 30 THEN CASE WHEN week <= today THEN week + 7 ELSE week END
  ELSE CASE WHEN month <= today THEN after ELSE month END END AS expiry,
  CASE WHEN tenor < 30 THEN 'weekly' ELSE 'monthly' END AS line FROM s)
SELECT strftime(expiry, '%Y-%m-%d') AS expiry, line, count(*) AS contracts FROM e GROUP BY ALL"""


def q_strike_step(spark, d):
    li = table(spark, d, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity") / F.col("l_linenumber")
    return rounded(li.select(strike_step(price).alias("step"), "l_quantity").groupBy("step").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")))


S_STRIKE_STEP = """WITH p AS (SELECT l_extendedprice / l_quantity / l_linenumber AS price, l_quantity FROM lineitem)
SELECT CASE WHEN price < 10 THEN 0.5 WHEN price < 50 THEN 1 WHEN price < 100 THEN 2.5
  WHEN price < 250 THEN 5 WHEN price < 1000 THEN 10 ELSE 50 END::DOUBLE AS step,
  count(*) AS lines, sum(l_quantity) AS quantity FROM p GROUP BY 1"""

QUERIES = {
    "norm_cdf": (q_norm_cdf, S_NORM_CDF),
    "bs_price": (q_bs_price, S_BS_PRICE),
    "bs_greeks": (q_bs_greeks, S_BS_GREEKS),
    "american_price": (q_american_price, S_AMERICAN_PRICE),
    "base_valuation": (q_base_valuation, S_BASE_VALUATION),
    "early_exercise_premium": (q_early_exercise_premium, S_EARLY_EXERCISE),
    "shock_axis": (q_shock_axis, S_SHOCK_AXIS),
    "scenario_grid": (q_scenario_grid, S_SCENARIO_GRID),
    "resolve_moves": (q_resolve_moves, S_RESOLVE_MOVES),
    "scenario_lookup": (q_scenario_lookup, S_SCENARIO_LOOKUP),
    "daily_sigma": (q_daily_sigma, S_DAILY_SIGMA),
    "scenario_pnl_equity": (q_scenario_pnl_equity, S_PNL_EQUITY),
    "scenario_pnl_euro": (q_scenario_pnl_euro, S_PNL_EURO),
    "scenario_pnl_american": (q_scenario_pnl_american, S_PNL_AMERICAN),
    "scenario_pnl_eep": (q_scenario_pnl_eep, S_PNL_EEP),
    "third_friday": (q_third_friday, S_THIRD_FRIDAY),
    "listed_expiry": (q_listed_expiry, S_LISTED_EXPIRY),
    "strike_step": (q_strike_step, S_STRIKE_STEP),
}
