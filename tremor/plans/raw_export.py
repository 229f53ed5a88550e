"""The book rendered as an awkward raw export, all text, and its mapping profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapping import FieldMapping, Profile
from . import sql as Q
from .book import BATCH_DATE, book

SECTOR_CODES = {"PROMO": "Promotional", "ECONOMY": "Economy", "SMALL": "Small"}
# Date patterns the expiry column mixes, by position.
FORMS = (("MM/dd/yyyy", "%m/%d/%Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyyMMdd", "%Y%m%d"),
         ("dd-MMM-yyyy", "%d-%b-%Y"))


def raw_export(spark, sf_dir: str) -> DataFrame:
    """One text row per position; ``Ref`` ties it to the book."""
    b = book(spark, sf_dir)
    option, pid = F.col("is_option"), F.col("position_id")
    lots = F.format_number(F.abs(F.col("qty")) * 100, 0)
    day = F.date_add(F.lit(BATCH_DATE), F.col("dte").cast("int"))
    expiry = F.lit(None).cast("string")
    for i, (pattern, _) in enumerate(FORMS):
        expiry = F.when(pid % len(FORMS) == i, F.date_format(day, pattern)).otherwise(expiry)
    columns = {
        "Segment": F.col("sector"), "Unit": F.col("desk"),
        "Root": F.concat(F.lit(" "), F.lower("underlying"), F.lit("\t")),
        "Kind": F.when(~option, "N/A").when(F.col("is_call"), "calls").otherwise("Put"),
        "Last Day": F.when(option, expiry).otherwise(""),
        "Strike Mils": F.when(option, (F.col("strike") * 1000).cast("long").cast("string")).otherwise("0"),
        "Spot": F.concat(F.lit("$"), F.format_string("%.2f", "underlying_price")),
        "Vol Pct": F.format_string("%.1f", F.col("iv") * 100),
        "Realised": F.when(pid % 5 == 0, "n.a.").otherwise(F.format_string("%.4f", F.col("iv") / 20)),
        "Direction": F.when(F.col("qty") < 0, "short").otherwise("LONG"),
        "Lots": F.when(pid % 3 == 0, F.concat(F.lit("("), lots, F.lit(")")))
        .when(pid % 3 == 1, F.concat(F.lit("+"), lots)).otherwise(lots),
        "Book Ref": F.concat(F.lower("account"), F.lit(" ")), "Ref": pid.cast("string"),
    }
    return b.select(*[c.alias(name) for name, c in columns.items()])


def profile(firm_id: str = "ACME", **options) -> Profile:
    wanted = {
        "account": ("Book Ref", "upper", {}), "underlying": ("Root", "upper", {}),
        "qty": ("Lots", "signed_by", {"side_column": "Direction", "short_values": ["short"]}),
        "right": ("Kind", "call_put", {}), "expiry": ("Last Day", "date", {}),
        "strike": ("Strike Mils", "scale", {"factor": 0.001}), "iv": ("Vol Pct", "scale", {"factor": 0.01}),
        "underlying_price": ("Spot", "number", {}), "desk": ("Unit", "trim", {}),
        "sector": ("Segment", "map_values", {"values": SECTOR_CODES, "default": "Other"}),
    }
    mappings = [FieldMapping(f, source, transform=t, params=p) for f, (source, t, p) in wanted.items()]
    return Profile(firm_id, read_options=options, mappings=[*mappings, FieldMapping("firm", constant=firm_id)])


_LOTS = "format('{:,}', (abs(qty) * 100)::BIGINT)"
RAW = f"""{Q.BOOK},
raw AS (SELECT position_id, position_id::VARCHAR AS row_id, lower(account) || ' ' AS acct,
  ' ' || lower(underlying) || chr(9) AS ticker,
  CASE WHEN qty < 0 THEN 'short' ELSE 'LONG' END AS side,
  CASE position_id % 3 WHEN 0 THEN '(' || {_LOTS} || ')' WHEN 1 THEN '+' || {_LOTS} ELSE {_LOTS} END AS quantity,
  CASE WHEN is_option THEN (strike * 1000)::BIGINT::VARCHAR ELSE '0' END AS strike_price,
  CASE WHEN NOT is_option THEN '' ELSE CASE position_id % 4
    {' '.join(f"WHEN {i} THEN strftime(DATE '{BATCH_DATE}' + dte::INTEGER, '{f}')" for i, (_, f) in enumerate(FORMS))}
    END END AS expiration,
  CASE WHEN NOT is_option THEN 'N/A' WHEN is_call THEN 'calls' ELSE 'Put' END AS cp,
  '$' || printf('%.2f', underlying_price) AS und_last, printf('%.1f', iv * 100) AS implied_vol,
  sector AS product, desk,
  CASE WHEN position_id % 5 = 0 THEN 'n.a.' ELSE printf('%.4f', iv / 20) END AS hist_vol
  FROM book)"""

NUMBER = ("CASE WHEN {c} LIKE '(%)' THEN -1 ELSE 1 END * "
          "TRY_CAST(regexp_replace({c}, '[,$()+\\s]', '', 'g') AS DOUBLE)")

# The mapped frame in SQL, from the raw text alone.
MAPPED = f"""{RAW},
mapped0 AS (SELECT position_id, upper(trim(acct)) AS account, upper(trim(ticker, chr(9) || ' ')) AS underlying,
  abs({NUMBER.format(c='quantity')}) * CASE WHEN upper(side) = 'SHORT' THEN -1 ELSE 1 END AS qty,
  {NUMBER.format(c='strike_price')} * 0.001 AS strike,
  strftime(coalesce(try_strptime(expiration, '%Y-%m-%d'), try_strptime(expiration, '%m/%d/%Y'),
    try_strptime(expiration, '%d-%b-%Y'), try_strptime(expiration, '%Y%m%d')), '%Y-%m-%d') AS expiry,
  CASE upper(cp) WHEN 'CALLS' THEN 'C' WHEN 'PUT' THEN 'P' ELSE '-' END AS "right",
  {NUMBER.format(c='und_last')} AS underlying_price, {NUMBER.format(c='implied_vol')} * 0.01 AS iv,
  CASE product WHEN 'PROMO' THEN 'Promotional' WHEN 'ECONOMY' THEN 'Economy' WHEN 'SMALL' THEN 'Small'
    ELSE 'Other' END AS sector, desk FROM raw),
mapped AS MATERIALIZED (SELECT *, account AS master_account, 'ACME' AS firm, 'Unclassified' AS industry,
  CASE WHEN strike > 0 THEN 'OPTION' ELSE 'EQUITY' END AS instrument_type, strike > 0 AS is_option,
  "right" = 'C' AS is_call, CASE WHEN strike > 0 THEN 100 ELSE 1 END::DOUBLE AS multiplier,
  CASE WHEN strike > 0 THEN greatest(date_diff('day', DATE '{BATCH_DATE}', expiry::DATE), 0) ELSE 0 END::DOUBLE AS dte,
  CASE WHEN strike > 0 THEN underlying || ' ' || expiry || ' ' || round(strike)::BIGINT || "right"
    ELSE underlying END AS contract, 0.042::DOUBLE AS rate, 0::DOUBLE AS div_yield FROM mapped0)"""
MAPPED_COLUMNS = ("account", "master_account", "desk", "firm", "underlying", "sector", "industry",
                  "instrument_type", "strike", "expiry", "right", "contract", "qty", "multiplier",
                  "underlying_price", "iv", "dte", "rate", "div_yield", "is_option", "is_call")
