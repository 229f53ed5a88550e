"""Registered queries on pivots, filters, rollups, templates and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.alerts import (EVERY_BATCH, STATE, AlertRule, breaches, evaluate, events,
                                reconcile, to_notify)
from ..operators.distinct import bitmaps, dictionary, level_counts
from ..operators.filters import Filter, typed_path
from ..operators.flatten import flatten, report_rows
from ..operators.pivot import (PivotRequest, cardinalities, distinct_values, null_nonfinite, pivot,
                               pivot_by, totals)
from ..operators.rollup import rollups, serve_rollup
from ..operators.templates import default_template, select_template
from ..operators.valuation import value_batch
from ..session import written
from . import sql as Q
from .book import GRID, batch, book
from .common import rounded

SUMMED = (*Q.MEASURES, *Q.SCENARIOS)
LEVEL = (*SUMMED, "worst")
ACCOUNT_DRILL = ("firm", "desk", "master_account", "account")


def _level_sql(group: str, where: str = "TRUE", having: str = "TRUE", extra: str = "",
               shown=LEVEL, tail: str = "", cells: str = "") -> str:
    """A pivot level over ``batch``; ``cells`` adds aggregates per group."""
    return f"""SELECT {group}, positions{extra}, {Q.rounded_list(shown)} FROM (
  SELECT *, {Q.WORST} AS worst FROM (
    SELECT {group}, {Q.sums()}{cells} FROM batch WHERE {where} GROUP BY {group}))
WHERE {having} {tail}"""


def q_pivot_level(spark, d):
    return rounded(pivot(batch(spark, d), PivotRequest(("sector", "underlying"))).rows)


S_PIVOT_LEVEL = Q.with_batch(_level_sql("sector"))


def q_pivot_drill(spark, d):
    b = batch(spark, d)
    request = PivotRequest(ACCOUNT_DRILL, path=(("firm", "ASIA"),)).child("NATION_12")
    return rounded(pivot(b, request).rows)


S_PIVOT_DRILL = Q.with_batch(_level_sql("master_account", "firm = 'ASIA' AND desk = 'NATION_12'"))


def q_pivot_leaf(spark, d):
    request = PivotRequest(("firm",), path=(("firm", "EUROPE"),))
    return rounded(pivot(batch(spark, d), request).rows)


_LEAF_KEYS = ("position_id, firm, desk, master_account, account, sector, industry, underlying, "
              "instrument_type, expiry, strike, \"right\", contract")
S_PIVOT_LEAF = Q.with_batch(f"""SELECT {_LEAF_KEYS}, {Q.rounded_list(LEVEL)}
FROM (SELECT *, {Q.WORST} AS worst FROM batch WHERE firm = 'EUROPE')""")


def q_pivot_worst(spark, d):
    rows = pivot(batch(spark, d), PivotRequest(("underlying",))).rows
    return rounded(rows.select("underlying", "positions", "worst"))


S_PIVOT_WORST = Q.with_batch(_level_sql("underlying", shown=("worst",)))


def q_pivot_worst_idx(spark, d):
    request = PivotRequest(("account",), include_worst_scenario=True)
    return rounded(pivot(batch(spark, d), request).rows.select(
        "account", "positions", "worst", "worst_idx"))


S_PIVOT_WORST_IDX = Q.with_batch(_level_sql(
    "account", shown=("worst",), extra=f", ({Q.WORST_IDX})::BIGINT AS worst_idx"))

DETAILS = ("desk", "account", "underlying", "right")


def _cell(d: str) -> str:
    n = f"(count(DISTINCT {d}) + max(({d} IS NULL)::INT))"
    return f", {n} AS {d.strip(chr(34))}__n, CASE WHEN {n} = 1 THEN max({d}) END AS {d.strip(chr(34))}_v"


def q_pivot_details(spark, d):
    request = PivotRequest(("contract",), detail_dimensions=DETAILS)
    rows = pivot(batch(spark, d), request).rows
    return rounded(rows.select(
        "contract", "positions", *[x for c in DETAILS for x in (F.col(c).alias(f"{c}_v"), f"{c}__n")],
        "worst"))


S_PIVOT_DETAILS = Q.with_batch(_level_sql(
    "contract", shown=("worst",), cells="".join(_cell(c) for c in ("desk", "account", "underlying", '"right"')),
    extra="".join(f", {c}_v, {c}__n" for c in DETAILS)))


def q_pivot_having(spark, d):
    filters = (Filter("worst", "lessThan", -250_000.5), Filter("positions", "greaterThanOrEqual", 30))
    return rounded(pivot(batch(spark, d), PivotRequest(("account",), filters=filters)).rows)


S_PIVOT_HAVING = Q.with_batch(_level_sql(
    "account", having="worst < -250000.5 AND positions >= 30"))


def q_pivot_sorted(spark, d):
    """The twelve mildest desks: a descending sort that a limit makes visible."""
    request = PivotRequest(("desk",), sort=(("worst", True), ("no_such", False)), limit=12)
    return rounded(pivot(batch(spark, d), request).rows)


S_PIVOT_SORTED = Q.with_batch(_level_sql("desk", tail="ORDER BY worst_raw DESC LIMIT 12").replace(
    f"{Q.WORST} AS worst FROM", f"{Q.WORST} AS worst, {Q.WORST} AS worst_raw FROM"))


def q_pivot_page(spark, d):
    request = PivotRequest(("account",), sort=(("worst", False),), offset=20, limit=30)
    return rounded(pivot(batch(spark, d), request).rows)


S_PIVOT_PAGE = Q.with_batch(_level_sql("account", tail="ORDER BY worst_raw LIMIT 30 OFFSET 20").replace(
    f"{Q.WORST} AS worst FROM", f"{Q.WORST} AS worst, {Q.WORST} AS worst_raw FROM"))


def q_pivot_totals(spark, d):
    filters = (Filter("worst", "lessThan", -1_000_000.5),)
    return rounded(totals(batch(spark, d), PivotRequest(("master_account", "account"), filters=filters)))


S_PIVOT_TOTALS = Q.with_batch(f"""SELECT positions, {Q.rounded_list(LEVEL)} FROM (
  SELECT *, {Q.WORST} AS worst FROM (
    SELECT coalesce(sum(positions), 0)::BIGINT AS positions,
      {', '.join(f'coalesce(sum({c}), 0) AS {c}' for c in SUMMED)} FROM (
      SELECT *, {Q.WORST} AS worst FROM (
        SELECT master_account, {Q.sums()} FROM batch GROUP BY master_account))
    WHERE worst < -1000000.5))""")


def q_pivot_multi(spark, d):
    """Expiry by strike.  Single far options tie across scenarios to the last bit,
    so the index of the worst scenario is compared on coarser groups below."""
    rows = pivot_by(batch(spark, d), ["expiry", "strike"], {"instrument_type": "OPTION"})
    return rounded(rows.drop("worst_idx"))


S_PIVOT_MULTI = Q.with_batch(_level_sql("expiry, strike", "instrument_type = 'OPTION'"))


def q_pivot_multi_idx(spark, d):
    return rounded(pivot_by(batch(spark, d), ["desk", "sector"], measures=("delta",)).select(
        "desk", "sector", "positions", "delta", "worst", "worst_idx"))


S_PIVOT_MULTI_IDX = Q.with_batch(_level_sql(
    "desk, sector", shown=("delta", "worst"), extra=f", ({Q.WORST_IDX})::BIGINT AS worst_idx"))


# -- filters -----------------------------------------------------------------


def _filtered(filters, group="sector"):
    def run(spark, d):
        request = PivotRequest((group,), filters=filters, measures=("und_qty",))
        rows = pivot(book(spark, d).withColumn("und_qty", F.col("qty") * F.col("multiplier")), request)
        return rounded(rows.rows)
    return run


def _filtered_sql(where, group="sector", having="TRUE"):
    return Q.with_book(f"""SELECT * FROM (SELECT {group}, count(*) AS positions,
  {Q.rounded('sum(qty * multiplier)', 0, 'und_qty')} FROM book WHERE {where} GROUP BY {group})
WHERE {having}""")


q_filter_text = _filtered((
    Filter("sector", "notEqual", "SMALL"), Filter("account", "contains", "00"),
    Filter("account", "notContains", "77"), Filter("industry", "startsWith", "Brand#1"),
    Filter("strike", "endsWith", "0.0"), Filter("instrument_type", "equals", "OPTION")), "industry")
S_FILTER_TEXT = _filtered_sql(
    "sector <> 'SMALL' AND account LIKE '%00%' AND account NOT LIKE '%77%' "
    "AND industry LIKE 'Brand#1%' AND strike % 1 = 0 AND instrument_type = 'OPTION'", "industry")

q_filter_number = _filtered((
    Filter("strike", "inRange", 800.0, 1100.0), Filter("iv", "greaterThan", 0.2),
    Filter("dte", "lessThanOrEqual", 400.0), Filter("qty", "greaterThanOrEqual", -20.0),
    Filter("underlying_price", "lessThan", 990.0), Filter("strike", "notEqual", 900.0)))
S_FILTER_NUMBER = _filtered_sql(
    "strike BETWEEN 800 AND 1100 AND iv > 0.2 AND dte <= 400 AND qty >= -20 "
    "AND underlying_price < 990 AND strike <> 900")

q_filter_in = _filtered((Filter("desk", "in", ("NATION_1", "NATION_7", "NATION_19")),), "desk")
S_FILTER_IN = _filtered_sql("desk IN ('NATION_1', 'NATION_7', 'NATION_19')", "desk")


def q_filter_null(spark, d):
    """Blank and not blank over a column that is null for equities."""
    b = book(spark, d).withColumns({
        "expiry": F.when(F.col("is_option"), F.col("expiry")),
        "und_qty": F.col("qty") * F.col("multiplier")})
    rows = [
        pivot(b, PivotRequest(("sector",), filters=(Filter("expiry", op),), measures=("und_qty",)))
        .rows.withColumn("op", F.lit(op)) for op in ("blank", "notBlank")]
    return rounded(rows[0].unionByName(rows[1]))


S_FILTER_NULL = Q.with_book(f"""SELECT sector, count(*) AS positions,
  {Q.rounded('sum(qty * multiplier)', 0, 'und_qty')},
  CASE WHEN is_option THEN 'notBlank' ELSE 'blank' END AS op FROM book GROUP BY sector, op""")


def q_filter_pre_post(spark, d):
    """iv and dte select positions; positions and delta test the aggregate."""
    filters = (Filter("iv", "greaterThan", 0.25), Filter("dte", "lessThan", 365.0),
               Filter("delta", "greaterThan", 0.5), Filter("positions", "greaterThan", 5))
    return rounded(pivot(batch(spark, d), PivotRequest(("account",), filters=filters)).rows)


S_FILTER_PRE_POST = Q.with_batch(_level_sql(
    "account", "iv > 0.25 AND dte < 365", "delta > 0.5 AND positions > 5"))


def q_typed_path(spark, d):
    """Drill keys arrive as text; the strike key is cast to the column's type."""
    b = book(spark, d).withColumn("und_qty", F.col("qty") * F.col("multiplier"))
    dims = ("strike", "right", "sector")
    request = PivotRequest(dims, typed_path(b, dims, ("900.0", "C")), measures=("und_qty",))
    return rounded(pivot(b, request).rows)


S_TYPED_PATH = _filtered_sql("strike = 900 AND \"right\" = 'C'")


# -- values, rollups, tree ----------------------------------------------------


def q_distinct_values(spark, d):
    """The first thousand values of a filter list, as the operator offers them."""
    return distinct_values(book(spark, d), "contract", limit=1000)


S_DISTINCT_VALUES = Q.with_book("SELECT DISTINCT contract FROM book ORDER BY contract LIMIT 1000")


def q_distinct_values_all(spark, d):
    return distinct_values(book(spark, d), "contract")


S_DISTINCT_VALUES_ALL = Q.with_book("SELECT DISTINCT contract FROM book")


def q_unknown_op(spark, d):
    """What becomes of filters: a known operator answers, an unknown one is refused before anything runs."""
    b = book(spark, d).withColumn("und_qty", F.col("qty") * F.col("multiplier"))
    out = None
    for op, value in (("equals", "SMALL"), ("isLike", "SMALL"), ("EQUALS", "SMALL"), ("", None), ("startsWith", "SM")):
        request = PivotRequest(("sector",), filters=(Filter("sector", op, value),), measures=("und_qty",))
        try:
            rows = pivot(b, request).rows.agg(F.coalesce(F.sum("positions"), F.lit(0)).alias("positions"))
        except ValueError:
            rows = spark.range(1).select(F.lit(None).cast("long").alias("positions"))
        one = rows.select(F.lit(op).alias("op"), "positions")
        out = one if out is None else out.unionByName(one)
    return out


S_UNKNOWN_OP = Q.with_book("""SELECT op, CASE WHEN op IN ('equals', 'startsWith') THEN n END AS positions
FROM (VALUES ('equals'), ('isLike'), ('EQUALS'), (''), ('startsWith')) v(op), (SELECT count(*) FILTER (sector = 'SMALL') AS n FROM book)""")


def q_cardinality(spark, d):
    return cardinalities(book(spark, d))


S_CARDINALITY = Q.with_book("SELECT " + ", ".join(
    f'count(DISTINCT "{c}") AS "{c}"' for c in
    ("firm", "desk", "master_account", "account", "sector", "industry", "underlying",
     "instrument_type", "expiry", "strike", "right", "contract")) + " FROM book")

COUNTED = ("underlying", "contract", "strike", "expiry")


def q_details_from_bitmaps(spark, d):
    """Distinct details of accounts, folded to masters, desks and firms without another look at the positions."""
    positions = book(spark, d).withColumn("expiry", F.when(F.col("is_option"), F.col("expiry")))
    # Each detail is a pass over the book's texts.
    b = written(positions.select(*dict.fromkeys((*ACCOUNT_DRILL, *COUNTED))), "book")
    codes = dictionary(b, COUNTED)
    maps = bitmaps(b, ACCOUNT_DRILL, COUNTED, codes)
    levels = [ACCOUNT_DRILL[:n] for n in (4, 3, 2, 1)]
    return rounded(level_counts(maps, levels, COUNTED))


def _counted_sql(n: int) -> str:
    keys = ", ".join(ACCOUNT_DRILL[:n])
    rest = "".join(f", NULL::VARCHAR AS {c}" for c in ACCOUNT_DRILL[n:])
    counts = ", ".join(f"count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS {c}__n" for c in COUNTED)
    return f"SELECT {n}::BIGINT AS level, {keys}{rest}, {counts} FROM b GROUP BY {keys}"


S_DETAILS_FROM_BITMAPS = Q.with_book("").rstrip() + """, b AS (SELECT * REPLACE (CASE WHEN is_option THEN expiry END AS expiry) FROM book)
""" + " UNION ALL BY NAME ".join(f"({_counted_sql(n)})" for n in (4, 3, 2, 1))

TREE = PivotRequest(("firm", "desk", "account"), sort=(("worst", False),), detail_dimensions=("sector",))


def q_tree_flatten(spark, d):
    """Firm, desk and account as one ordered tree, whole."""
    tree = flatten(batch(spark, d), TREE, 3)
    return rounded(tree.drop(*Q.SCENARIOS))


def _tree_level(level: int) -> str:
    dims = ("firm", "desk", "account")
    keys = ", ".join(dims[:level + 1])
    rest = "".join(f", NULL::VARCHAR AS {x}" for x in dims[level + 1:])
    return f"""SELECT {level}::BIGINT AS level, {dims[level]} AS label, {keys}{rest}, {Q.sums()},
  CASE WHEN count(DISTINCT sector) = 1 THEN max(sector) END AS sector, count(DISTINCT sector) AS sector__n
  FROM batch GROUP BY {keys}"""


_TREE = " UNION ALL BY NAME ".join(f"({_tree_level(i)})" for i in range(3))
S_TREE_FLATTEN = Q.with_batch(f"""SELECT level, label, firm, desk, account, positions, sector, sector__n,
  {Q.rounded_list((*Q.MEASURES, 'worst'))}
FROM (SELECT *, {Q.WORST} AS worst FROM ({_TREE}))""")


def q_tree_top(spark, d):
    """The first 500 rows of the tree, worst groups first on every level."""
    tree = flatten(batch(spark, d), TREE, 3, 500)
    return rounded(tree.select("level", "label", "firm", "desk", "account", "positions", "worst"))


S_TREE_TOP = Q.with_batch(f"""SELECT level, label, firm, desk, account, positions, {Q.rounded('worst')} FROM (
  SELECT *, max(CASE WHEN level = 0 THEN w END) OVER (PARTITION BY firm) AS w0,
    max(CASE WHEN level = 1 THEN w END) OVER (PARTITION BY firm, desk) AS w1
  FROM (SELECT *, {Q.WORST} AS worst, {Q.WORST} AS w FROM ({_TREE})))
ORDER BY w0, firm, level > 0, w1, desk, level > 1, w, account LIMIT 500""")


def q_report_export(spark, d):
    request = PivotRequest(("sector", "industry"), detail_dimensions=("account", "sector"))
    report = report_rows(batch(spark, d), request, default_template(), GRID, 2)
    return rounded(report.select(
        "level", "group", "account", "account_count", "positions", F.col("Current NLV").alias("nlv"),
        F.col("-2 Sdev : Contract Risk").alias("s002"), F.col("Max Risk").alias("worst")), 0)


S_REPORT_EXPORT = Q.with_batch(f"""SELECT level, "group",
  CASE WHEN account_count = 1 THEN account END AS account, account_count, positions,
  {Q.rounded('market_value', 0, 'nlv')}, {Q.rounded('s002', 0)}, {Q.rounded('worst', 0)} FROM (
  SELECT *, {Q.WORST} AS worst FROM (
    SELECT 0::BIGINT AS level, sector AS "group", {Q.sums()}, count(DISTINCT account) AS account_count,
      max(account) AS account FROM batch GROUP BY sector
    UNION ALL SELECT 1, industry, {Q.sums()}, count(DISTINCT account), max(account)
    FROM batch GROUP BY sector, industry))""")

ROLLED = ("firm", "desk", "master_account", "account", "sector", "industry", "underlying",
          "instrument_type", "expiry", "strike", "right")


def q_rollup_all(spark, d):
    """All rollups below the size gate, with two of the detail cells."""
    rolled = rollups(written(batch(spark, d), "rollup"))
    key = F.lit(None).cast("string")
    for c in (*ROLLED, "contract"):
        key = F.when(F.col("dimension") == c, F.col(c).cast("string")).otherwise(key)
    return rounded(rolled.select(
        "dimension", key.alias("key"), "account__n", "contract__n", "positions", *LEVEL))


def _rolled_sql(c: str) -> str:
    key = f'"{c}"' if c != "strike" else "CAST(strike::DECIMAL(20,1) AS VARCHAR)"
    def n(x):
        return "NULL::BIGINT" if x == c else f"count(DISTINCT {x})"
    return (f"SELECT '{c}' AS dimension, {key} AS key, {n('account')} AS account__n, "
            f"{n('contract')} AS contract__n, {Q.sums()} FROM batch GROUP BY {key}")


S_ROLLUP_ALL = Q.with_batch(f"""SELECT dimension, key, account__n, contract__n, positions, {Q.rounded_list(LEVEL)}
FROM (SELECT *, {Q.WORST} AS worst FROM ({' UNION ALL '.join(_rolled_sql(c) for c in (*ROLLED, 'contract'))}))
WHERE (SELECT count(DISTINCT contract) FROM batch) <= 50000 OR dimension <> 'contract'""")


def q_rollup_serve(spark, d):
    # The passes of the rollups share one written book.
    valued = value_batch(written(book(spark, d), "book"), GRID)
    stored = rollups(valued, dimensions=("firm", "desk", "sector"))
    request = PivotRequest(("desk", "account"), measures=("delta", "vega"),
                           detail_dimensions=("sector", "firm"), sort=(("worst", False),), limit=10)
    served = serve_rollup(stored, ("firm", "desk", "sector"), request)
    return rounded(served.rows.select(
        "desk", "positions", "delta", "vega", "worst", "sector__n", "firm", "firm__n"))


S_ROLLUP_SERVE = Q.with_batch(f"""SELECT desk, positions, {Q.rounded_list(('delta', 'vega', 'worst'))},
  sector__n, CASE WHEN firm__n = 1 THEN firm_v END AS firm, firm__n FROM (
  SELECT *, {Q.WORST} AS worst, {Q.WORST} AS w FROM (
    SELECT desk, {Q.sums()}, count(DISTINCT sector) AS sector__n, count(DISTINCT firm) AS firm__n,
      max(firm) AS firm_v FROM batch GROUP BY desk)) ORDER BY w LIMIT 10""")


def q_template_select(spark, d):
    """The default template plus a column whose coordinates the grid lacks."""
    from ..operators.templates import ColumnTemplate, TemplateColumn

    base = default_template()
    template = ColumnTemplate("t", (*base.columns, TemplateColumn("absent", price=9.0, vol=0.0)))
    rows = pivot(batch(spark, d), PivotRequest(("underlying",), measures=template.measures())).rows
    out = select_template(rows, template, GRID, ("underlying",))
    names = ("nlv", "size", "down2", "down1", "up1", "up2", "delta", "gamma", "vega", "theta", "max_risk", "absent")
    renamed = out.toDF("underlying", *names, "missing_columns")
    return rounded(renamed.withColumn("missing_columns", F.concat_ws(",", "missing_columns")), 0)


S_TEMPLATE_SELECT = Q.with_batch(f"""SELECT underlying, {Q.rounded('market_value', 0, 'nlv')},
  {Q.rounded('und_qty', 0, 'size')}, {Q.rounded('s002', 0, 'down2')}, {Q.rounded('s007', 0, 'down1')},
  {Q.rounded('s012', 0, 'up1')}, {Q.rounded('s017', 0, 'up2')}, {', '.join(Q.rounded(g, 0, g) for g in ('delta', 'gamma', 'vega', 'theta'))},
  {Q.rounded('worst', 0, 'max_risk')},
  NULL::DOUBLE AS absent, 'absent' AS missing_columns
FROM (SELECT *, {Q.WORST} AS worst FROM (SELECT underlying, {Q.sums()} FROM batch GROUP BY underlying))""")


def q_null_nonfinite(spark, d):
    """Ratios that are infinite or undefined for some rows become null."""
    b = book(spark, d).select(
        "position_id",
        F.when(F.col("strike") == 0, F.lit(float("inf"))).otherwise(
            F.col("underlying_price") / F.col("strike")).alias("moneyness"),
        F.when(F.col("iv") == 0, F.lit(float("nan"))).otherwise(F.col("dte") / F.col("iv")).alias("ratio"))
    return rounded(null_nonfinite(b), 9)


S_NULL_NONFINITE = Q.with_book("""SELECT position_id,
  CASE WHEN strike <> 0 THEN round(underlying_price / strike, 9) END AS moneyness,
  CASE WHEN iv <> 0 THEN round(dte / iv, 9) END AS ratio FROM book""")


# -- alerts -------------------------------------------------------------------

RULES = (
    AlertRule(1, "desk loss", ("desk",), conditions=(Filter("worst", "lessThan", -5_000_000.5),)),
    AlertRule(2, "option accounts", ("account",), scope=(Filter("instrument_type", "equals", "OPTION"),),
              conditions=(Filter("worst", "lessThan", -150_000.5), Filter("positions", "greaterThan", 4)),
              mode=EVERY_BATCH),
)


def _breach_sql(source: str) -> str:
    rule1 = f"""SELECT 1::BIGINT AS rule_id, desk AS group_key, {Q.sums()} FROM {source} GROUP BY desk"""
    rule2 = f"""SELECT 2::BIGINT, account, {Q.sums()} FROM {source}
      WHERE instrument_type = 'OPTION' GROUP BY account"""
    return f"""SELECT * FROM (SELECT *, {Q.WORST} AS worst FROM ({rule1} UNION ALL {rule2}))
  WHERE (rule_id = 1 AND worst < -5000000.5)
     OR (rule_id = 2 AND worst < -150000.5 AND positions > 4)"""


def q_alert_breaches(spark, d):
    return rounded(evaluate(batch(spark, d), RULES).breaches)


S_ALERT_BREACHES = Q.with_batch(
    f"SELECT rule_id, group_key, positions, {Q.rounded_list((*Q.MEASURES, 'worst'))} "
    f"FROM ({_breach_sql('batch')})")


def _moved(spark, d):
    """Breaches of the puts as the state before, of the calls and equities after."""
    b = batch(spark, d)
    before = evaluate(b.where(F.col("right") == "P"), RULES).breaches
    after = evaluate(b.where(F.col("right") != "P"), RULES).breaches
    first = F.to_timestamp(F.lit("2026-01-15 10:00:00"))
    second = F.to_timestamp(F.lit("2026-01-15 10:30:00"))
    empty = spark.createDataFrame([], STATE)
    state = reconcile(before, empty, first).drop("status")
    return after, reconcile(after, state, second), second


def q_alert_transitions(spark, d):
    _, moved, _ = _moved(spark, d)
    stamp = "yyyy-MM-dd HH:mm"
    return moved.select("rule_id", "group_key", "status", "breaching",
                        F.date_format("since", stamp).alias("since"),
                        F.date_format("last_seen_at", stamp).alias("last_seen"))


_MOVED = f"""before AS ({_breach_sql("(SELECT * FROM batch WHERE \"right\" = 'P')")}),
after AS ({_breach_sql("(SELECT * FROM batch WHERE \"right\" <> 'P')")}),
moved AS (SELECT rule_id, group_key, CASE WHEN a.positions IS NOT NULL AND b.positions IS NOT NULL
    THEN 'continuing' WHEN a.positions IS NOT NULL THEN 'new' ELSE 'resolved' END AS status
  FROM after a FULL JOIN before b USING (rule_id, group_key))"""
S_ALERT_TRANSITIONS = Q.with_batch("").rstrip() + f""", {_MOVED}
SELECT rule_id, group_key, status, status <> 'resolved' AS breaching,
  CASE status WHEN 'new' THEN '2026-01-15 10:30' WHEN 'continuing' THEN '2026-01-15 10:00' END AS since,
  '2026-01-15 10:30' AS last_seen FROM moved"""


def q_alert_notify(spark, d):
    after, moved, _ = _moved(spark, d)
    return rounded(to_notify(after, moved, RULES).select(
        "rule_id", "group_key", "status", "positions", "worst"))


S_ALERT_NOTIFY = Q.with_batch("").rstrip() + f""", {_MOVED}
SELECT rule_id, group_key, status, positions, {Q.rounded('worst')}
FROM after JOIN moved USING (rule_id, group_key) WHERE status = 'new' OR rule_id = 2"""


def q_alert_events(spark, d):
    after, moved, at = _moved(spark, d)
    return events(to_notify(after, moved, RULES), "b2", at).drop("fired_at")


S_ALERT_EVENTS = Q.with_batch("").rstrip() + f""", {_MOVED}
SELECT rule_id, 'b2' AS batch_id, count(*) AS breach_rows,
  count(*) FILTER (status = 'new') AS new_rows
FROM after JOIN moved USING (rule_id, group_key) WHERE status = 'new' OR rule_id = 2 GROUP BY rule_id"""


def q_alert_isolation(spark, d):
    """A rule on no column, one without a test and one that compares a text with a number report errors; the others run."""
    bad = AlertRule(9, "broken", ("sector",), conditions=(Filter("no_such", "lessThan", 0.0),))
    empty = AlertRule(10, "no condition", ("sector",))
    other = AlertRule(11, "other type", ("sector",), scope=(Filter("account", "greaterThan", 5),), conditions=RULES[0].conditions)
    result = evaluate(batch(spark, d), (bad, *RULES, empty, other))
    counted = result.breaches.groupBy("rule_id").agg(F.count(F.lit(1)).alias("breaches"))
    failed = spark.createDataFrame([(k,) for k in result.errors], "rule_id long")
    return counted.select("rule_id", F.lit(True).alias("ran"), "breaches").unionByName(
        failed.select("rule_id", F.lit(False).alias("ran"), F.lit(0).cast("long").alias("breaches")))


S_ALERT_ISOLATION = Q.with_batch(f"""SELECT rule_id, TRUE AS ran, count(*) AS breaches
FROM ({_breach_sql('batch')}) GROUP BY rule_id UNION ALL VALUES (9, FALSE, 0), (10, FALSE, 0), (11, FALSE, 0)""")

# Thirty rules on three dimensions and five scopes.
_SCOPES = (
    ((), "TRUE"),
    ((Filter("instrument_type", "equals", "OPTION"),), "instrument_type = 'OPTION'"),
    ((Filter("right", "equals", "C"), Filter("iv", "greaterThan", 0.2)), "\"right\" = 'C' AND iv > 0.2"),
    ((Filter("sector", "startsWith", "S"),), "sector LIKE 'S%'"),
    ((Filter("strike", "inRange", 800.0, 1200.0),), "strike BETWEEN 800 AND 1200"),
)
_WATCHED = (("desk", -500_000.5), ("account", -50_000.5), ("industry", -400_000.5))
MANY_RULES = tuple(
    AlertRule(100 + k, f"rule {k}", (dim,), scope=_SCOPES[k % 5][0],
              conditions=(Filter("worst", "lessThan", limit * (1 + k // 15)), Filter("positions", "greaterThan", k % 3)),
              measures=("delta", "vega") if k % 2 else ("market_value",))
    for k in range(30) for dim, limit in [_WATCHED[k % 3]])


def q_alert_shared_scan(spark, d):
    """Thirty rules, evaluated from one scan of the batch."""
    found = evaluate(batch(spark, d), MANY_RULES).breaches
    return rounded(found.select("rule_id", "group_key", "positions", "market_value", "delta", "worst"))


def _many_sql() -> str:
    parts = []
    for k, rule in enumerate(MANY_RULES):
        (dim,), limit, own = rule.dimensions, rule.conditions[0].value, k % 2 == 0
        parts.append(f"""SELECT {rule.rule_id}::BIGINT AS rule_id, {dim} AS group_key, positions, {Q.WORST} AS worst,
  {'market_value' if own else 'NULL::DOUBLE AS market_value'}, {'NULL::DOUBLE AS delta' if own else 'delta'}
  FROM (SELECT {dim}, {Q.sums()} FROM batch WHERE {_SCOPES[k % 5][1]} GROUP BY {dim})
  WHERE {Q.WORST} < {limit} AND positions > {k % 3}""")
    return " UNION ALL ".join(parts)


S_ALERT_SHARED_SCAN = Q.with_batch(
    f"SELECT rule_id, group_key, positions, {Q.rounded_list(('market_value', 'delta', 'worst'))} FROM ({_many_sql()})")

QUERIES = {
    "pivot_level": (q_pivot_level, S_PIVOT_LEVEL),
    "pivot_drill": (q_pivot_drill, S_PIVOT_DRILL),
    "pivot_leaf": (q_pivot_leaf, S_PIVOT_LEAF),
    "pivot_worst": (q_pivot_worst, S_PIVOT_WORST),
    "pivot_worst_idx": (q_pivot_worst_idx, S_PIVOT_WORST_IDX),
    "pivot_details": (q_pivot_details, S_PIVOT_DETAILS),
    "pivot_having": (q_pivot_having, S_PIVOT_HAVING),
    "pivot_sorted": (q_pivot_sorted, S_PIVOT_SORTED),
    "pivot_page": (q_pivot_page, S_PIVOT_PAGE),
    "pivot_totals": (q_pivot_totals, S_PIVOT_TOTALS),
    "pivot_multi": (q_pivot_multi, S_PIVOT_MULTI),
    "pivot_multi_idx": (q_pivot_multi_idx, S_PIVOT_MULTI_IDX),
    "filter_text": (q_filter_text, S_FILTER_TEXT),
    "filter_number": (q_filter_number, S_FILTER_NUMBER),
    "filter_in": (q_filter_in, S_FILTER_IN),
    "filter_null": (q_filter_null, S_FILTER_NULL),
    "filter_pre_post": (q_filter_pre_post, S_FILTER_PRE_POST),
    "typed_path": (q_typed_path, S_TYPED_PATH),
    "distinct_values": (q_distinct_values, S_DISTINCT_VALUES),
    "details_from_bitmaps": (q_details_from_bitmaps, S_DETAILS_FROM_BITMAPS),
    "distinct_values_all": (q_distinct_values_all, S_DISTINCT_VALUES_ALL),
    "unknown_op": (q_unknown_op, S_UNKNOWN_OP),
    "alert_shared_scan": (q_alert_shared_scan, S_ALERT_SHARED_SCAN),
    "cardinality": (q_cardinality, S_CARDINALITY),
    "tree_flatten": (q_tree_flatten, S_TREE_FLATTEN),
    "tree_top": (q_tree_top, S_TREE_TOP),
    "report_export": (q_report_export, S_REPORT_EXPORT),
    "rollup_all": (q_rollup_all, S_ROLLUP_ALL),
    "rollup_serve": (q_rollup_serve, S_ROLLUP_SERVE),
    "template_select": (q_template_select, S_TEMPLATE_SELECT),
    "null_nonfinite": (q_null_nonfinite, S_NULL_NONFINITE),
    "alert_breaches": (q_alert_breaches, S_ALERT_BREACHES),
    "alert_transitions": (q_alert_transitions, S_ALERT_TRANSITIONS),
    "alert_notify": (q_alert_notify, S_ALERT_NOTIFY),
    "alert_events": (q_alert_events, S_ALERT_EVENTS),
    "alert_isolation": (q_alert_isolation, S_ALERT_ISOLATION),
}
