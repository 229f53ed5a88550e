"""SQL text of the shared parts of the DuckDB checks: the book and its valuation.

Written from the textbook formulas (not from the Arrow kernel), so a check
compares two independent computations.
"""

from __future__ import annotations

from ..functions.normal import DENOMINATOR, INV_SQRT_2PI, NUMERATOR, RATIONAL_LIMIT, SQRT_2PI
from ..schema import GREEKS, MEASURES
from .book import BATCH_DATE, GRID

SCENARIOS = tuple(f"s{i:03d}" for i in range(len(GRID)))

# Decimals kept when comparing: sums are rounded well above summation noise.
DIGITS = {"market_value": 1, "und_qty": 0, "delta": 1, "gamma": 3, "vega": 1, "theta": 2,
          "rho": 2, "worst": 0, "mark": 4, **{s: 0 for s in SCENARIOS}}


def rounded(column: str, digits: int | None = None, name: str | None = None) -> str:
    d = DIGITS.get(column, 4) if digits is None else digits
    # Adding zero turns a negative zero into a plain one.
    return f"round({column}, {d}) + 0::DOUBLE AS {name or column}"


def rounded_list(columns, digits: int | None = None) -> str:
    return ", ".join(rounded(c, digits) for c in columns)


def _poly(coefficients, x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def cdf(x: str) -> str:
    """Normal CDF of a column name or a short expression."""
    a = f"abs({x})"
    bell = f"exp(-0.5 * ({x}) * ({x}))"
    tail = f"{a} + 0.65"
    for k in (4, 3, 2, 1):
        tail = f"{a} + {k} / ({tail})"
    low = (f"CASE WHEN {a} < {RATIONAL_LIMIT!r} THEN {bell} * {_poly(NUMERATOR, a)} / "
           f"{_poly(DENOMINATOR, a)} ELSE {bell} / ({tail}) / {SQRT_2PI!r}::DOUBLE END")
    return f"(CASE WHEN {x} > 0 THEN 1 - ({low}) ELSE {low} END)"


def pdf(x: str) -> str:
    return f"(exp(-0.5 * {x} * {x}) * {INV_SQRT_2PI!r}::DOUBLE)"


BOOK = f"""
li AS (SELECT row_number() OVER () - 1 AS position_id, * FROM lineitem),
wide_li AS (
  SELECT *, l_returnflag <> 'N' AS is_option,
         1 + abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 730 AS life
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
book0 AS (
  SELECT position_id, r_name AS firm, n_name AS desk, n_name || '-' || c_mktsegment AS master_account,
    c_name AS account, p_type AS sector, p_brand AS industry, 'P' || p_partkey AS underlying,
    CASE WHEN is_option THEN 'OPTION' ELSE 'EQUITY' END AS instrument_type, is_option,
    is_option AND l_linestatus = 'O' AS is_call,
    CASE WHEN NOT is_option THEN '-' WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS "right",
    CASE WHEN is_option THEN round(p_retailprice * (0.8 + 4.0 * l_discount) / 10) * 10
         ELSE 0 END::DOUBLE AS strike,
    CASE WHEN is_option THEN life ELSE 0 END::DOUBLE AS dte,
    CASE WHEN is_option THEN strftime(DATE '{BATCH_DATE}' + life::INTEGER, '%Y-%m-%d')
         ELSE '-' END AS expiry,
    CASE WHEN l_linenumber % 2 = 0 THEN -l_quantity ELSE l_quantity END AS qty,
    CASE WHEN is_option THEN 100 ELSE 1 END::DOUBLE AS multiplier, p_retailprice AS underlying_price,
    CASE WHEN is_option THEN 0.15 + 5.0 * l_tax ELSE 0 END::DOUBLE AS iv, 0.042::DOUBLE AS rate,
    l_discount / 4 AS div_yield
  FROM wide_li),
book AS MATERIALIZED (
  SELECT *, CASE WHEN is_option THEN underlying || ' ' || expiry || ' ' || strike::BIGINT || "right"
       ELSE underlying END AS contract,
    greatest(iv, 0.01) / sqrt(252.0) AS sigma_daily FROM book0)"""

SHOCKS = "shocks(sid, label, shock, vol_shift, days) AS (VALUES " + ", ".join(
    f"({i}, '{p.label}', {p.underlying!r}::DOUBLE, {p.vol!r}::DOUBLE, {p.days!r}::DOUBLE)"
    for i, p in enumerate(GRID.points)) + ")"


def european(source: str, name: str) -> str:
    """CTEs pricing ``position_id sid s k t r q v is_call`` rows European."""
    return f"""
{name}_d AS (
  SELECT *, (ln(s / k) + (r - q + 0.5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM
  (SELECT * REPLACE (greatest(t, 1e-8) AS t, greatest(v, 1e-8) AS v),
     t <= 1e-8 OR v <= 1e-8 AS dead FROM {source})),
{name}_n AS (
  SELECT *, d1 - v * sqrt(t) AS d2, {cdf('d1')} AS n1, {cdf('(d1 - v * sqrt(t))')} AS n2 FROM {name}_d),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN dead THEN greatest(CASE WHEN is_call THEN s - k ELSE k - s END, 0)
    ELSE greatest(s * exp(-q * t) * n1 - k * exp(-r * t) * n2
      - CASE WHEN is_call THEN 0 ELSE s * exp(-q * t) - k * exp(-r * t) END, 0) END AS euro
  FROM {name}_n)"""


def american(source: str, name: str) -> str:
    """CTEs adding the American price ``amer`` to a European-priced source."""
    def phi(gamma: str, barrier: str) -> str:
        d = f"(-(ln(ss / {barrier}) + (b + ({gamma} - 0.5) * v2) * t) / vt)"
        e = f"({d} - 2 * ln(x / ss) / vt)"
        return (f"exp((-rr + {gamma} * b + 0.5 * {gamma} * ({gamma} - 1) * v2) * t) * pow(ss, {gamma})"
                f" * (@{d}@ - pow(x / ss, 2 * b / v2 + 2 * {gamma} - 1) * @{e}@)")

    terms = {"p1": ("beta", "x"), "p2": ("1.0", "x"), "p3": ("1.0", "kk"),
             "p4": ("0.0", "x"), "p5": ("0.0", "kk")}
    args, phis = [], []
    for key, (gamma, barrier) in terms.items():
        text = phi(gamma, barrier)
        pieces = text.split("@")
        args += [f"{pieces[1]} AS {key}_d", f"{pieces[3]} AS {key}_e"]
        phis.append(f"{pieces[0]}{cdf(key + '_d')}{pieces[2]}{cdf(key + '_e')}{pieces[4]} AS {key}")
    return f"""
{name}_a AS (
  SELECT *, CASE WHEN is_call THEN s ELSE k END AS ss, CASE WHEN is_call THEN k ELSE s END AS kk,
    CASE WHEN is_call THEN r ELSE q END AS rr, CASE WHEN is_call THEN r - q ELSE q - r END AS b,
    v * v AS v2, v * sqrt(t) AS vt FROM {source}),
{name}_b AS (SELECT *, 0.5 - b / v2 + sqrt(pow(b / v2 - 0.5, 2) + 2 * rr / v2) AS beta FROM {name}_a
  WHERE b < rr AND NOT dead),
{name}_c AS (SELECT *, beta / (beta - 1) * kk AS top, greatest(kk, rr / (rr - b) * kk) AS base
  FROM {name}_b),
{name}_e AS (SELECT *, greatest(base + (top - base)
    * (1 - exp(-(b * t + 2 * vt) * base / (top - base))), kk * (1 + 1e-9)) AS x FROM {name}_c),
{name}_f AS (SELECT *, (x - kk) * pow(x, -beta) AS alpha, {', '.join(args)} FROM {name}_e),
{name}_g AS (SELECT *, {', '.join(phis)} FROM {name}_f),
{name}_h AS (SELECT position_id, sid, CASE WHEN ss >= x THEN ss - kk ELSE
    alpha * pow(ss, beta) - alpha * p1 + p2 - p3 - kk * p4 + kk * p5 END AS early FROM {name}_g),
{name} AS MATERIALIZED (
  SELECT e.*, greatest(coalesce(early, 0), euro, CASE WHEN is_call THEN s - k ELSE k - s END, 0) AS amer
  FROM {source} e LEFT JOIN {name}_h USING (position_id, sid))"""


BASE_LEGS = """
legs AS (
  SELECT position_id, -1 AS sid, underlying_price AS s, strike AS k, dte / 365 AS t, rate AS r,
    div_yield AS q, iv AS v, is_call FROM book WHERE is_option)"""

SHOCKED_LEGS = """
legs AS (
  SELECT position_id, -1 AS sid, underlying_price AS s, strike AS k, dte / 365 AS t, rate AS r,
    div_yield AS q, iv AS v, is_call FROM book WHERE is_option
  UNION ALL
  SELECT position_id, sid, underlying_price * (1 + sigma_daily * shock), strike,
    greatest(dte - days, 0) / 365, rate, div_yield, greatest(iv + vol_shift, 0.001), is_call
  FROM book CROSS JOIN shocks WHERE is_option)"""

GREEKS_SQL = f"""
greeks AS (
  SELECT position_id,
    CASE WHEN is_call THEN exp(-q * t) * n1 ELSE exp(-q * t) * (n1 - 1) END AS delta,
    exp(-q * t) * {pdf('d1')} / (s * v * sqrt(t)) AS gamma,
    s * exp(-q * t) * {pdf('d1')} * sqrt(t) / 100 AS vega,
    (-s * exp(-q * t) * {pdf('d1')} * v / (2 * sqrt(t)) + CASE WHEN is_call
      THEN q * s * exp(-q * t) * n1 - r * k * exp(-r * t) * n2
      ELSE r * k * exp(-r * t) * (1 - n2) - q * s * exp(-q * t) * (1 - n1) END) / 365 AS theta,
    CASE WHEN is_call THEN k * t * exp(-r * t) * n2
      ELSE -k * t * exp(-r * t) * (1 - n2) END / 10000 AS rho
  FROM euros WHERE sid = -1)"""

_UNIT = {"delta": "1"}
_VALUED = f"""
  SELECT b.*, CASE WHEN is_option THEN amer ELSE underlying_price END AS mark,
    (CASE WHEN is_option THEN amer ELSE underlying_price END) * qty * multiplier AS market_value,
    qty * multiplier AS und_qty,
    {', '.join(f"CASE WHEN is_option THEN g.{x} ELSE {_UNIT.get(x, '0')} END * qty * multiplier AS {x}"
               for x in GREEKS)}"""

VALUED = ",".join([BOOK, BASE_LEGS, european("legs", "euros"), american("euros", "amers"), GREEKS_SQL, f"""
valued AS MATERIALIZED ({_VALUED}
  FROM book b LEFT JOIN (SELECT position_id AS pid, amer FROM amers WHERE sid = -1) ON position_id = pid
  LEFT JOIN greeks g USING (position_id))"""])

PNL_SQL = f"""
pnl AS (
  SELECT a.position_id, a.sid, (a.amer - m.amer) * qty * multiplier AS pnl
  FROM amers a JOIN amers m ON a.position_id = m.position_id AND m.sid = -1
  JOIN book b ON a.position_id = b.position_id WHERE a.sid >= 0
  UNION ALL
  SELECT position_id, sid, (underlying_price * (1 + sigma_daily * shock) - underlying_price)
    * qty * multiplier FROM book CROSS JOIN shocks WHERE NOT is_option),
matrix AS (
  SELECT position_id, {', '.join(f'max(CASE WHEN sid = {i} THEN pnl END) AS {s}' for i, s in enumerate(SCENARIOS))}
  FROM pnl GROUP BY position_id)"""

BATCH = ",".join([
    BOOK, SHOCKS, SHOCKED_LEGS, european("legs", "euros"), american("euros", "amers"), GREEKS_SQL,
    PNL_SQL, f"""
batch AS MATERIALIZED ({_VALUED}, {', '.join(SCENARIOS)}
  FROM book b JOIN matrix USING (position_id)
  LEFT JOIN (SELECT position_id AS pid, amer FROM amers WHERE sid = -1) ON position_id = pid
  LEFT JOIN greeks g USING (position_id))"""])


def with_book(tail: str) -> str:
    return f"WITH {BOOK} {tail}"


def with_valued(tail: str) -> str:
    return f"WITH {VALUED} {tail}"


def with_batch(tail: str) -> str:
    return f"WITH {BATCH} {tail}"


def sums(columns=(*MEASURES, *SCENARIOS)) -> str:
    return "count(*) AS positions, " + ", ".join(f"coalesce(sum({c}), 0) AS {c}" for c in columns)


WORST = f"least({', '.join(SCENARIOS)})"
# The first scenario that attains the minimum.
WORST_IDX = ("CASE " + " ".join(f"WHEN {s} = worst THEN {i}" for i, s in enumerate(SCENARIOS))
             + " END")
