"""Registered queries on sources, mapping, quality, the batch store and bookkeeping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transforms import TRANSFORMS, MappingContext
from ..operators.ingest import ALERT_ROWS, REGISTRY, RUNS, Workspace, compact, ingest_file, read_table
from ..operators.ingest_many import ingest_files
from ..operators.mapping import (FieldMapping, apply_profile, contract_label, finalise, inspect_source,
                                 latest_profile, next_version, preview_mapping, resolve_sigma)
from ..operators.quality import QualityContext, findings
from ..operators.pivot import PivotRequest
from ..operators.registry import latest_entries, latest_ready, ready_batches
from ..operators.scenarios import column_of, pct_grid
from ..operators.valuation import scenario_pnl, value_batch
from ..session import SPARK_ERRORS, fresh_path, held, move_path, written
from ..sources.batch_store import (BatchStore, delete_batch, list_batches, load_batch, load_positions, raw_book,
                                   read_frames, read_rollups, write_batch)
from ..sources.export import export_csv, keep_files, quarantine, restored
from ..sources.positions import read_positions
from ..sources.text import read_source
from ..streaming.drop import PROFILES, drop_by_profiles, drop_ingest, stored_profile
from . import sql as Q
from .book import BATCH_DATE, GRID, batch, book, table
from .common import rounded
from .pivot_queries import RULES
from .raw_export import MAPPED, MAPPED_COLUMNS, NUMBER, RAW, profile, raw_export

FIRMS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
CTX = MappingContext(BATCH_DATE, ("Ref", "Book Ref", "Root", "Direction", "Lots"))


def _csv(spark, d) -> str:
    """The raw export written as CSV files; returns their folder."""
    path = fresh_path(spark, "export")
    raw_export(spark, d).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _t(name, column, **params):
    return TRANSFORMS[name](F.col(f"`{column}`"), params, CTX)


def q_scan_raw_text(spark, d):
    raw = read_source(spark, _csv(spark, d))
    return raw.select(
        F.col("`Ref`").alias("row_id"), F.col("`Book Ref`").alias("acct"),
        F.col("Lots").alias("quantity"), F.col("`Strike Mils`").alias("strike_price"),
        F.col("Last Day").alias("expiration"), F.col("`Kind`").alias("cp"),
        F.col("`Spot`").alias("und_last"))


S_SCAN_RAW_TEXT = f"""WITH {RAW} SELECT row_id, acct, quantity, strike_price,
  nullif(expiration, '') AS expiration, nullif(cp, 'N/A') AS cp, und_last FROM raw"""


def q_scan_raw_parquet(spark, d):
    raw = read_source(spark, f"{d}/lineitem.parquet", "parquet")
    return rounded(raw.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")))


S_SCAN_RAW_PARQUET = """SELECT l_returnflag, count(*) AS lines, sum(l_quantity) AS quantity
FROM lineitem GROUP BY l_returnflag"""


def q_prepared_positions(spark, d):
    """A prepared Parquet file without a deviation column: volatility stands in."""
    path = fresh_path(spark, "prepared")
    book(spark, d).drop("sigma_daily").write.parquet(path)
    p = read_positions(spark, path, "parquet")
    return rounded(p.select("position_id", "account", "contract", "qty", "sigma_daily"), 8)


S_PREPARED = Q.with_book("""SELECT position_id, account, contract, qty,
  round(sigma_daily, 8) AS sigma_daily FROM book""")


def q_prepared_csv(spark, d):
    """The same from CSV, types restored from the canonical schema."""
    path = fresh_path(spark, "prepared")
    book(spark, d).drop("sigma_daily").write.option("header", True).option("compression", "gzip").csv(path)
    p = read_positions(spark, path, "csv")
    return rounded(p.groupBy("firm", "is_option").agg(
        F.count(F.lit(1)).alias("positions"), F.sum("strike").alias("strike"),
        F.max("dte").alias("dte"), F.avg("sigma_daily").alias("sigma_daily")), 6)


S_PREPARED_CSV = Q.with_book("""SELECT firm, is_option, count(*) AS positions, sum(strike) AS strike,
  max(dte) AS dte, round(avg(sigma_daily), 6) AS sigma_daily FROM book GROUP BY firm, is_option""")


def q_map_trim_upper(spark, d):
    return raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("trim", "Root").alias("trimmed"),
        _t("upper", "Root").alias("uppered"), _t("identity", "Root").alias("same"))


S_MAP_TRIM_UPPER = f"""WITH {RAW} SELECT row_id, trim(ticker, chr(9) || ' ') AS trimmed,
  upper(trim(ticker, chr(9) || ' ')) AS uppered, ticker AS same FROM raw"""


def q_map_number(spark, d):
    return rounded(raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("number", "Lots").alias("quantity"),
        _t("number", "Spot").alias("price"), _t("number", "Realised").alias("hist_vol"),
        _t("number", "Book Ref").alias("not_a_number")))


S_MAP_NUMBER = f"""WITH {RAW} SELECT row_id, {NUMBER.format(c='quantity')} AS quantity,
  {NUMBER.format(c='und_last')} AS price, TRY_CAST(hist_vol AS DOUBLE) AS hist_vol,
  NULL::DOUBLE AS not_a_number FROM raw"""


def q_map_scale(spark, d):
    return rounded(raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"),
        _t("scale", "Strike Mils", factor=0.001).alias("strike"),
        _t("scale", "Vol Pct", factor=0.01).alias("iv"), _t("scale", "Spot").alias("price")), 6)


S_MAP_SCALE = f"""WITH {RAW} SELECT row_id, round(strike_price::DOUBLE * 0.001, 6) AS strike,
  round(implied_vol::DOUBLE * 0.01, 6) AS iv, {NUMBER.format(c='und_last')} AS price FROM raw"""


def q_map_abs_negate(spark, d):
    return rounded(raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("abs", "Lots").alias("size"),
        _t("negate", "Lots").alias("negated")))


S_MAP_ABS_NEGATE = f"""WITH {RAW} SELECT row_id, abs({NUMBER.format(c='quantity')}) AS size,
  -({NUMBER.format(c='quantity')}) AS negated FROM raw"""


def q_map_signed_by(spark, d):
    return rounded(raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("signed_by", "Lots", side_column="Direction").alias("qty"),
        _t("signed_by", "Lots", side_column="Direction", short_values=["long"]).alias("inverse")))


S_MAP_SIGNED_BY = f"""WITH {RAW}, n AS (SELECT row_id, side, abs({NUMBER.format(c='quantity')}) AS m FROM raw)
SELECT row_id, CASE WHEN side = 'short' THEN -m ELSE m END AS qty,
  CASE WHEN side = 'LONG' THEN -m ELSE m END AS inverse FROM n"""


def q_map_call_put(spark, d):
    return raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("call_put", "Kind").alias("right"),
        _t("call_put", "Kind", call_values=["put"], put_values=["n/a"]).alias("odd"))


S_MAP_CALL_PUT = f"""WITH {RAW} SELECT row_id,
  CASE cp WHEN 'calls' THEN 'C' WHEN 'Put' THEN 'P' ELSE '-' END AS "right",
  CASE cp WHEN 'Put' THEN 'C' WHEN 'N/A' THEN 'P' ELSE '-' END AS odd FROM raw"""


def q_map_date(spark, d):
    return raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"), _t("date", "Last Day").alias("expiry"),
        _t("date", "Last Day", format="%d/%m/%Y").alias("day_first"))


_FIRST = "try_strptime(expiration, '{}')"
_OTHERS = ", ".join(_FIRST.format(f) for f in ("%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%b-%Y"))
# Eight digits are a date only without separators.
_DIGITS = "CASE WHEN length(expiration) = 8 THEN try_strptime(expiration, '%Y%m%d') END"
S_MAP_DATE = f"""WITH {RAW} SELECT row_id,
  strftime(coalesce({_DIGITS}, {_OTHERS}), '%Y-%m-%d') AS expiry,
  strftime(coalesce({_DIGITS}, {_FIRST.format('%d/%m/%Y')}, {_OTHERS}), '%Y-%m-%d') AS day_first FROM raw"""


def q_map_values(spark, d):
    return raw_export(spark, d).select(
        F.col("`Ref`").alias("row_id"),
        _t("map_values", "Segment", values={"PROMO": "P", "SMALL": "S"}, default="?").alias("code"),
        _t("map_values", "Segment", values={"PROMO": "P"}).alias("no_default"))


S_MAP_VALUES = f"""WITH {RAW} SELECT row_id,
  CASE product WHEN 'PROMO' THEN 'P' WHEN 'SMALL' THEN 'S' ELSE '?' END AS code,
  CASE product WHEN 'PROMO' THEN 'P' END AS no_default FROM raw"""


def _mapped(spark, d):
    """Mapped positions keyed by the book's own ids."""
    raw = raw_export(spark, d)
    ctx = MappingContext(BATCH_DATE, tuple(raw.columns))
    fields = [m.column(ctx) for m in profile().mappings]
    return finalise(raw.select(F.col("`Ref`").cast("long").alias("position_id"), *fields), BATCH_DATE)


def q_apply_profile(spark, d):
    """CSV scan, mapping and derivation; ids are file order, so rows compare without them."""
    raw = read_source(spark, _csv(spark, d))
    return rounded(apply_profile(raw, profile(), BATCH_DATE).select(*MAPPED_COLUMNS), 6)


_MAPPED_DOUBLES = ("strike", "qty", "multiplier", "underlying_price", "iv", "dte", "rate", "div_yield")


def _mapped_select(columns) -> str:
    return ", ".join(f"round({c}, 6) + 0::DOUBLE AS {c}" if c in _MAPPED_DOUBLES else f'"{c}"'
                     for c in columns)


S_APPLY_PROFILE = f"WITH {MAPPED} SELECT {_mapped_select(MAPPED_COLUMNS)} FROM mapped"


def q_finalise(spark, d):
    return rounded(_mapped(spark, d).select("position_id", *MAPPED_COLUMNS), 6)


S_FINALISE = f"WITH {MAPPED} SELECT position_id, {_mapped_select(MAPPED_COLUMNS)} FROM mapped"


def q_contract_label(spark, d):
    """Labels of whole and fractional strikes."""
    b = book(spark, d).withColumn(
        "strike", F.when(F.col("is_option"), F.col("strike") + (F.col("position_id") % 5) * 0.25)
        .otherwise(F.lit(0.0)))
    return b.groupBy(contract_label().alias("contract")).agg(F.count(F.lit(1)).alias("positions"))


S_CONTRACT_LABEL = Q.with_book("""SELECT CASE WHEN is_option THEN underlying || ' ' || expiry || ' ' ||
    regexp_replace(regexp_replace((strike + (position_id % 5) * 0.25)::DECIMAL(20,2)::VARCHAR, '0+$', ''), '\\.$', '')
    || "right" ELSE underlying END AS contract, count(*) AS positions FROM book GROUP BY 1""")


def q_position_id(spark, d):
    """Dense ids in file order."""
    from ..operators.identity import with_position_id

    li = with_position_id(table(spark, d, "lineitem"))
    return rounded(li.select("position_id", "l_orderkey", "l_linenumber", "l_quantity"))


S_POSITION_ID = """SELECT row_number() OVER () - 1 AS position_id, l_orderkey,
  l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem"""


def q_sigma_from(spark, d):
    """Supplied deviations with gaps, and a column of nothing usable."""
    raw = raw_export(spark, d)
    base = raw.select(
        F.col("`Ref`").alias("row_id"), (_t("number", "Vol Pct") / 100).alias("iv"),
        _t("number", "Realised").alias("sigma_daily"))
    given = resolve_sigma(base).withColumn("variant", F.lit("supplied"))
    none = resolve_sigma(base.withColumn("sigma_daily", F.lit(0.0))).withColumn("variant", F.lit("zeros"))
    return rounded(given.unionByName(none).drop("iv"), 8)


S_SIGMA_FROM = f"""WITH {RAW} SELECT row_id, coalesce(TRY_CAST(hist_vol AS DOUBLE), 0.01) AS sigma_daily,
  TRUE AS sigma_supplied, 'supplied' AS variant FROM raw
UNION ALL SELECT row_id, round(greatest(implied_vol::DOUBLE / 100, 0.01) / sqrt(252.0), 8), FALSE, 'zeros' FROM raw"""


def q_inspect_source(spark, d):
    return inspect_source(read_source(spark, _ordered_csv(spark, raw_export(spark, d))))


_INSPECTED = {"Segment": "product", "Unit": "desk", "Root": "ticker", "Kind": "nullif(cp, 'N/A')", "Last Day": "nullif(expiration, '')",
              "Strike Mils": "strike_price", "Spot": "und_last", "Vol Pct": "implied_vol", "Realised": "hist_vol", "Direction": "side",
              "Lots": "quantity", "Book Ref": "acct", "Ref": "row_id"}
S_INSPECT_SOURCE = f"""WITH {RAW}, head AS (SELECT * FROM raw WHERE position_id < 5) """ + " UNION ALL ".join(
    f"""SELECT '{name}' AS "column", coalesce((SELECT list(v ORDER BY position_id) FROM (SELECT {sql} AS v, position_id FROM head) WHERE v IS NOT NULL), [])[1:3] AS samples,
  (SELECT count(*) FROM raw) AS "rows" """
    for name, sql in _INSPECTED.items())


def q_latest_profile(spark, d):
    """Every order priority is a profile whose saves are its order days."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("orders"))
    fresh = o.select(F.lit("ACME").alias("firm_id"), "name", "orders")
    saved = fresh.withColumns({"version": F.lit(1), "active": F.lit(True)})
    again = next_version(saved, fresh.where("name <> '5-LOW'").withColumn("orders", F.col("orders") * 2))
    return rounded(latest_profile(again))


S_LATEST_PROFILE = """WITH o AS (SELECT o_orderpriority AS name, count(*) AS orders FROM orders GROUP BY 1)
SELECT 'ACME' AS firm_id, name, CASE WHEN name = '5-LOW' THEN orders ELSE orders * 2 END AS orders,
  CASE WHEN name = '5-LOW' THEN 1 ELSE 2 END::BIGINT AS version, TRUE AS active FROM o"""


# -- quality -----------------------------------------------------------------


def _defective(spark, d):
    """The mapped book with one kind of defect injected per residue."""
    pid = F.col("position_id")

    def every(n, bad, name):
        return F.when(pid % n == 0, bad).otherwise(F.col(name)).alias(name)

    keep = ("underlying", "expiry", "is_option", "position_id")
    return book(spark, d).select(
        *keep, every(997, F.lit(None), "account"), every(61, F.lit(0.0), "underlying_price"),
        every(211, F.lit(0.0), "strike"), every(307, F.lit(-5.0), "dte"),
        every(401, F.lit("X"), "right"), every(503, F.lit(None), "iv").alias("iv0"),
        every(607, F.lit(None), "qty")).withColumn(
        "iv", F.when(pid % 701 == 0, F.lit(28.5)).otherwise(F.col("iv0"))).drop("iv0")


_DEFECTIVE = f"""{Q.BOOK}, bad AS (SELECT underlying, expiry, is_option, position_id,
  CASE WHEN position_id % 997 <> 0 THEN account END AS account,
  CASE WHEN position_id % 61 = 0 THEN 0 ELSE underlying_price END AS underlying_price,
  CASE WHEN position_id % 211 = 0 THEN 0 ELSE strike END AS strike,
  CASE WHEN position_id % 307 = 0 THEN -5 ELSE dte END AS dte,
  CASE WHEN position_id % 401 = 0 THEN 'X' ELSE "right" END AS "right",
  CASE WHEN position_id % 701 = 0 THEN 28.5 WHEN position_id % 503 <> 0 THEN iv END AS iv,
  CASE WHEN position_id % 607 <> 0 THEN qty END AS qty FROM book)"""


def q_dq_findings(spark, d):
    return findings(_defective(spark, d)).select("severity", "code", "count")


def _count(severity: str, code: str, condition: str) -> str:
    return (f"SELECT {severity} AS severity, '{code}' AS code, count(*) FILTER ({condition}) AS count "
            "FROM bad")


S_DQ_FINDINGS = f"WITH {_DEFECTIVE}, f AS (" + " UNION ALL ".join([
    _count("'error'", "null_required", "account IS NULL"),
    _count("'error'", "null_required", "qty IS NULL"),
    _count("CASE WHEN avg((underlying_price <= 0)::INT) > 0.01 THEN 'error' ELSE 'warning' END",
           "bad_price", "underlying_price <= 0"),
    _count("'error'", "option_without_strike", "is_option AND strike <= 0"),
    _count("'error'", "expired_option", "is_option AND dte < 0"),
    _count("'error'", "unknown_right", "is_option AND \"right\" NOT IN ('C', 'P')"),
    _count("'warning'", "missing_iv", "is_option AND (iv IS NULL OR iv <= 0)"),
    _count("'warning'", "implausible_iv", "iv > 5"),
    _count("'warning'", "zero_quantity", "qty IS NULL OR qty = 0"),
]) + ") SELECT * FROM f WHERE count > 0"


def q_dq_row_drift(spark, d):
    """One firm's positions against the whole book as the previous batch."""
    b = book(spark, d)
    before = QualityContext(previous_rows=table(spark, d, "lineitem").count())
    return findings(b.where("firm = 'ASIA'"), before).select("severity", "code", "count", "message")


S_DQ_ROW_DRIFT = Q.with_book("""SELECT CASE WHEN d / o >= 0.5 THEN 'error' ELSE 'warning' END AS severity,
  'row_drift' AS code, d AS count, 'rows: ' || format('{:,}', o) || ' before, now ' || format('{:,}', n) || ' (-'
  || round(100 * d / o)::BIGINT || '%)' AS message
FROM (SELECT *, o - n AS d FROM (SELECT count(*) FILTER (firm = 'ASIA') AS n, count(*) AS o FROM book))
WHERE d / o >= 0.2""")


def q_dq_accounts(spark, d):
    b = book(spark, d)
    before = QualityContext(previous_accounts=table(spark, d, "customer").count())
    return findings(b.where("firm = 'ASIA'"), before).select("severity", "code", "count")


S_DQ_ACCOUNTS = Q.with_book("""SELECT 'warning' AS severity, 'accounts_missing' AS code, o - n AS count
FROM (SELECT count(DISTINCT account) FILTER (firm = 'ASIA') AS n,
  (SELECT count(*) FROM customer) AS o FROM book) WHERE n < o * 0.8""")


def _renamed(raw):
    """The export without its price column's content: validation must refuse it."""
    return raw.withColumn("Spot", F.lit(""))


def q_ingest_gate(spark, d):
    """A good file, one without prices, one that misses columns, a short one, a profile that cannot work and a file that is gone."""
    folder = fresh_path(spark, "drop")
    work = Workspace(fresh_path(spark, "work"))
    with held(raw_export(spark, d), "export") as raw:
        variants = (
            ("good", raw), ("no_price", _renamed(raw)), ("misfit", raw.select("Book Ref", "Root")),
            ("short", raw.where("Unit = 'NATION_1'")))
        for name, frame in variants:
            frame.write.option("header", True).csv(f"{folder}/{name}")
    for name, _ in variants:
        ingest_file(spark, work, profile(), f"{folder}/{name}", name, BATCH_DATE)
    typo = profile()
    typo.mappings = [m for m in typo.mappings if m.field != "iv"] + [FieldMapping("iv", constant="abc")]
    ingest_file(spark, work, typo, f"{folder}/good", "typo", BATCH_DATE)
    ingest_file(spark, work, profile(), f"{folder}/gone", "gone", BATCH_DATE)
    runs = read_table(spark, work.table("runs"), RUNS)
    codes = F.array_join(F.array_sort(F.transform("findings", lambda f: f["code"])), ",")
    return runs.select(F.element_at(F.split("file", "/"), -1).alias("file"), "status", "rows",
                       "batch_id", codes.alias("codes"))


S_INGEST_GATE = f"""WITH {MAPPED}, n AS (SELECT count(*) AS everything,
  count(*) FILTER (desk = 'NATION_1') AS short FROM mapped)
SELECT 'good' AS file, 'succeeded' AS status, everything AS "rows", 'good' AS batch_id, '' AS codes FROM n
UNION ALL SELECT 'no_price', 'quarantined', everything, NULL, 'bad_price,null_required' FROM n
UNION ALL SELECT 'misfit', 'quarantined', 0, NULL, '' FROM n
UNION ALL SELECT 'short', 'quarantined', short, NULL, 'row_drift' FROM n
UNION ALL VALUES ('good', 'quarantined', 0, NULL, ''), ('gone', 'failed', 0, NULL, '')"""


def q_quarantine(spark, d):
    path = _csv(spark, d)
    where = fresh_path(spark, "quarantine")
    quarantine(spark, "ACME", path, "bad_price", where)
    kept = spark.read.parquet(where)
    return kept.groupBy("firm_id", "reason").agg(
        F.count_if(~F.startswith("raw_line", F.lit("Segment,"))).alias("lines"))


S_QUARANTINE = """SELECT 'ACME' AS firm_id, 'bad_price' AS reason, count(*) AS lines FROM lineitem"""


def q_stream_drop_ingest(spark, d):
    """The export dropped as one file per product, ingested by a stream with alerts."""
    folder = fresh_path(spark, "drop")
    work = Workspace(fresh_path(spark, "work"))
    raw = raw_export(spark, d).withColumn("__p", F.col("Segment"))
    raw.repartition("__p").write.partitionBy("__p").option("header", True).csv(folder)
    query = drop_ingest(spark, f"{folder}/*", work, profile(), BATCH_DATE,
                        fresh_path(spark, "offsets"), rules=RULES)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    runs = read_table(spark, work.table("runs"), RUNS)
    stored, sent = None, read_table(spark, work.table("alert_rows"), ALERT_ROWS)
    for r in list_batches(spark, work.store, "ACME").collect():
        frame = load_batch(spark, work.store, "ACME", r["batch_id"]).frame
        one = frame.groupBy("sector").agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("position_id").alias("ids")).withColumn("batch_id", F.lit(r["batch_id"]))
        stored = one if stored is None else stored.unionByName(one)
    fired = sent.groupBy("batch_id").agg(F.count(F.lit(1)).alias("alert_rows"), F.max("worst").alias("mildest"))
    mild = F.coalesce(F.col("mildest") < -150_000.5, F.lit(True))
    return runs.join(stored, "batch_id").join(fired, "batch_id", "left").select(
        "sector", "status", "rows", "error", "stored", "ids", mild.alias("alerts_hold"))


S_STREAM_DROP_INGEST = Q.with_book("""SELECT CASE sector WHEN 'PROMO' THEN 'Promotional' WHEN 'ECONOMY' THEN 'Economy'
  WHEN 'SMALL' THEN 'Small' ELSE 'Other' END AS sector, 'succeeded' AS status, count(*) AS "rows", '' AS error,
  count(*) AS stored, count(*) AS ids, TRUE AS alerts_hold FROM book GROUP BY book.sector""")


FILES = 60


def _files(raw):
    """The export's rows dealt to sixty files: the file, and what is to be wrong with it."""
    k = F.col("Ref").cast("long") % FILES
    kind = F.when(k % 10 == 3, "misfit").when(k % 10 == 5, "no_price").when(k % 10 == 7, "ragged").otherwise("good")
    return raw.withColumns({"__f": k, "__kind": kind})


def _dropped(spark, d) -> str:
    """Sixty files in a folder for each kind; returns the pattern of the folders."""
    folder = fresh_path(spark, "drop")
    with held(_files(raw_export(spark, d)), "export") as raw:
        _drop(raw, folder)
    return f"{folder}/*/*"


def _drop(raw, folder: str) -> None:
    columns = [c for c in raw.columns if not c.startswith("__")]
    out = lambda frame: frame.repartition("__f").write.partitionBy("__f").option("header", True)
    for kind in ("good", "misfit", "no_price"):
        mine = raw.where(F.col("__kind") == kind).drop("__kind")
        mine = mine.drop("Spot", "Kind") if kind == "misfit" else _renamed(mine) if kind == "no_price" else mine
        out(mine).csv(f"{folder}/{kind}")
    ragged = raw.where("__kind = 'ragged'")
    more = F.when(F.col("Ref").cast("long") < FILES, F.lit(",more")).otherwise(F.lit(""))
    line = F.concat(F.to_csv(F.struct(*[f"`{c}`" for c in columns]), {"quoteAll": "true"}), more)
    head = ragged.select("__f").distinct().select("__f", F.lit(0).alias("at"), F.lit(",".join(columns)).alias("value"))
    lines = head.unionByName(ragged.select("__f", F.lit(1).alias("at"), line.alias("value")))
    lines.repartition("__f").sortWithinPartitions("__f", "at").select("__f", "value").write.partitionBy("__f").option("header", False).text(f"{folder}/ragged")


def q_stream_many_files(spark, d):
    """Sixty files, good and bad mixed, in one micro-batch and one plan."""
    work = Workspace(fresh_path(spark, "work"))
    query = drop_ingest(spark, _dropped(spark, d), work, profile(), BATCH_DATE, fresh_path(spark, "offsets"), pattern="*.{csv,txt}", limit=2 * FILES)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    runs = read_table(spark, work.table("runs"), RUNS)
    ready = latest_entries(read_table(spark, work.table("registry"), REGISTRY)).where("status = 'ready'")
    ids = [r["batch_id"] for r in ready.select("batch_id").collect()]
    stored = read_frames(spark, work.store, "ACME", ids).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("stored"), F.count_distinct("position_id").alias("ids"), F.max("position_id").alias("last"))
    rolled = read_rollups(spark, work.store, "ACME", ids).where("dimension = 'desk'").groupBy("batch_id").agg(F.sum("positions").alias("rolled"))
    kept = spark.read.parquet(work.table("quarantine")).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    codes = F.array_join(F.array_sort(F.transform("findings", lambda f: f["code"])), ",")
    samples = F.coalesce(F.aggregate("findings", F.lit(0), lambda n, f: n + F.size(f["sample"])), F.lit(0))
    return runs.join(stored, "batch_id", "left").join(rolled, "batch_id", "left").join(kept, "file", "left").select(
        F.regexp_extract("file", r"__f=(\d+)", 1).cast("long").alias("f"), "status", "rows", codes.alias("codes"),
        samples.cast("long").alias("samples"), "stored", "ids", "last", "rolled", F.col("lines").alias("kept_lines"))


S_STREAM_MANY_FILES = f"""WITH {MAPPED} SELECT f, CASE k WHEN 3 THEN 'quarantined' WHEN 5 THEN 'quarantined'
    WHEN 7 THEN 'failed' ELSE 'succeeded' END AS status,
  CASE WHEN k IN (3, 7) THEN 0 ELSE n END AS "rows", CASE k WHEN 5 THEN 'bad_price,null_required' ELSE '' END AS codes,
  CASE k WHEN 5 THEN 6 ELSE 0 END AS samples, CASE WHEN k NOT IN (3, 5, 7) THEN n END AS stored,
  CASE WHEN k NOT IN (3, 5, 7) THEN n END AS ids, CASE WHEN k NOT IN (3, 5, 7) THEN n - 1 END AS "last",
  CASE WHEN k NOT IN (3, 5, 7) THEN n END AS rolled, CASE WHEN k IN (3, 5, 7) THEN n + 1 END AS kept_lines
FROM (SELECT position_id % {FILES} AS f, position_id % 10 AS k, count(*) AS n FROM mapped GROUP BY ALL)"""


def q_ingest_by_profile(spark, d):
    """Two firms' drops by their stored profiles; one firm saves a new version between two drops, and one file is nobody's."""
    folder, work, profiles = fresh_path(spark, "drop"), Workspace(fresh_path(spark, "work")), fresh_path(spark, "profiles")
    offsets = fresh_path(spark, "offsets")
    # One file for each drop, all from one pass; a drop is moved into place when its time has come.
    staged = fresh_path(spark, "staged")
    dealt = raw_export(spark, d).withColumn("__p", F.col("Ref").cast("long") % 5)
    dealt.repartition("__p").write.partitionBy("__p").option("header", True).csv(staged)

    def save(*rows):
        spark.createDataFrame([stored_profile(p, pattern, p.version) for p, pattern in rows], PROFILES).write.mode("append").parquet(profiles)

    def version(firm, n):
        p = profile(firm)
        p.version, p.mappings = n, [*p.mappings, FieldMapping("industry", constant=f"version {n}")]
        return p

    def drop(place, part):
        move_path(spark, f"{staged}/__p={part}", f"{folder}/{place}")
        query = drop_by_profiles(spark, f"{folder}/*/*", work, profiles, BATCH_DATE, offsets)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()

    save((version("ACME", 1), "^acme/"), (version("OTHR", 1), "^othr/"))
    drop("acme/a", 0)
    drop("othr/a", 1)
    save((version("ACME", 2), "^acme/"))
    drop("acme/b", 2)
    drop("othr/b", 3)
    drop("none/a", 4)
    ready = latest_entries(read_table(spark, work.table("registry"), REGISTRY)).where("status = 'ready'")
    out = None
    for firm in ("ACME", "OTHR"):
        ids = [r["batch_id"] for r in ready.where(F.col("firm_id") == firm).select("batch_id").collect()]
        one = read_frames(spark, work.store, firm, ids).groupBy("firm", "industry").agg(
            F.count(F.lit(1)).alias("positions"), F.count_distinct("batch_id").alias("batches"), F.sum("qty").alias("qty"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 0)


S_INGEST_BY_PROFILE = f"""WITH {MAPPED} SELECT CASE WHEN k IN (0, 2) THEN 'ACME' ELSE 'OTHR' END AS firm,
  CASE k WHEN 2 THEN 'version 2' ELSE 'version 1' END AS industry, count(*) AS positions,
  count(DISTINCT k) AS batches, round(sum(qty), 0) + 0::DOUBLE AS qty
FROM (SELECT *, position_id % 5 AS k FROM mapped) WHERE k <> 4 GROUP BY 1, 2"""


def _ordered_csv(spark, raw, compression: str = "none") -> str:
    """An export whose files hold the rows in the order of the book."""
    path = fresh_path(spark, "export")
    raw.orderBy(F.col("Ref").cast("long")).write.option("header", True).option("compression", compression).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def q_mapping_preview(spark, d):
    """The first twenty rows under a profile that reads percent as a fraction, beside what validation says of the whole file."""
    p = profile()
    p.mappings = [m for m in p.mappings if m.field != "iv"] + [FieldMapping("iv", "Vol Pct", transform="number")]
    shown = preview_mapping(read_source(spark, _ordered_csv(spark, raw_export(spark, d), "gzip")), p, BATCH_DATE)
    said = shown.findings.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "code", "count"))), ",").alias("findings"))
    return shown.rows.select("position_id", "account", "underlying", "qty", "strike", "expiry", "right", "iv", "contract").crossJoin(said)


S_MAPPING_PREVIEW = f"""WITH {MAPPED} SELECT position_id, account, underlying, qty, strike, expiry, "right",
  round(iv * 100, 6) AS iv, contract,
  (SELECT 'implausible_iv:' || count(*) FROM mapped WHERE iv * 100 > 5.0000001) || (SELECT CASE WHEN count(*) > 0 THEN ',missing_iv:' || count(*)
   ELSE '' END FROM mapped WHERE is_option AND iv <= 0) AS findings
FROM mapped WHERE position_id < 20"""


def q_quarantine_bytes(spark, d):
    """Lines of a rejected file in another encoding, with odd ends, are kept byte for byte."""
    path = fresh_path(spark, "odd")
    lines = table(spark, d, "nation").select(F.concat(F.lit("é"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, "\r").otherwise(" \t")).alias("value"), "n_nationkey")
    latin = F.encode("value", "ISO-8859-1").cast("string").alias("value")
    lines.repartition(1).sortWithinPartitions("n_nationkey").select(latin).write.text(path)
    where = fresh_path(spark, "quarantine")
    keep_files(spark, "ACME", [(path, "odd 1", "for no reason")], where)
    kept = spark.read.parquet(where)
    whole = restored(kept).select("key", F.sha2("bytes", 256).alias("file_sha256"))
    return kept.join(whole, "key").select(F.col("line").cast("long").alias("line"), "reason", F.sha2("raw", 256).alias("line_sha256"), "file_sha256")


S_QUARANTINE_BYTES = """WITH l AS (SELECT n_nationkey AS line, '\\xE9'::BLOB || encode(n_name) || CASE WHEN n_nationkey % 3 = 0
    THEN '\\x0D'::BLOB ELSE '\\x20\\x09'::BLOB END AS raw FROM nation),
w AS (SELECT sha256(unhex(string_agg(hex(raw || '\\x0A'::BLOB), '' ORDER BY line))) AS file_sha256 FROM l)
SELECT line::BIGINT AS line, 'for no reason' AS reason, sha256(raw) AS line_sha256, file_sha256 FROM l, w"""


def q_run_log(spark, d):
    """Run records with their samples and the sigma note, before and after the small files are merged, and after a rerun."""
    work = Workspace(fresh_path(spark, "work"))
    own = profile()
    own.mappings = [*own.mappings, FieldMapping("sigma_daily", "Realised", transform="number")]
    with held(raw_export(spark, d), "export") as raw:
        # The first two files are the same rows under two profiles.
        whole, priceless = _ordered_csv(spark, raw), _ordered_csv(spark, _renamed(raw))
    files = {"plain": (profile(), whole), "sigma": (own, whole), "no_price": (profile(), priceless)}
    for name, (p, path) in files.items():
        ingest_files(spark, work, p, [(path, name)], BATCH_DATE)

    def log(phase):
        runs = read_table(spark, work.table("runs"), f"{RUNS}, key string")
        each = runs.select("key", "status", "rows", "sigma_supplied", F.explode_outer("findings").alias("f"))
        return written(each.select(
            F.lit(phase).alias("phase"), F.col("key").alias("file"), "status", "rows", "sigma_supplied", F.col("f.code").alias("code"), F.col("f.count").alias("n"),
            F.size("f.sample").cast("long").alias("samples"), F.col("f.sample")[0]["account"].alias("first_account")), "log")

    out = log("before")
    compact(spark, work, "runs", RUNS, "ACME")
    compact(spark, work, "registry", REGISTRY, "ACME")
    out = out.unionByName(log("after"))
    ingest_files(spark, work, files["plain"][0], [(files["plain"][1], "plain")], BATCH_DATE)
    out = out.unionByName(log("again"))
    compact(spark, work, "runs", RUNS, "ACME")
    return out.unionByName(log("merged again"))


S_RUN_LOG = f"""WITH {MAPPED}, n AS (SELECT count(*) AS n, min_by(account, position_id) AS a FROM mapped)
SELECT phase, file, CASE WHEN file = 'no_price' THEN 'quarantined' ELSE 'succeeded' END AS status, n AS "rows",
  CASE file WHEN 'sigma' THEN TRUE WHEN 'plain' THEN FALSE END AS sigma_supplied, code,
  CASE WHEN code IS NOT NULL THEN n END AS n, CASE WHEN code IS NOT NULL THEN 3 END AS samples,
  CASE WHEN code IS NOT NULL THEN a END AS first_account
FROM n, (VALUES ('before'), ('after'), ('again'), ('merged again')) p(phase),
  (VALUES ('plain', NULL), ('sigma', NULL), ('no_price', 'bad_price'), ('no_price', 'null_required')) f(file, code)"""


# -- batch store --------------------------------------------------------------


def q_cold_positions(spark, d):
    """The raw book is all a reprice needs: store, reload, reprice."""
    store = BatchStore(fresh_path(spark, "store"))
    write_batch(batch(spark, d), store, "ACME", "b1", GRID, materialise=False)
    again = value_batch(load_positions(spark, store, "ACME", "b1"), GRID)
    return rounded(again.groupBy("sector").agg(
        F.count(F.lit(1)).alias("positions"), *[F.sum(c).alias(c) for c in (*Q.MEASURES, *Q.SCENARIOS)]))


S_COLD_POSITIONS = Q.with_batch(f"""SELECT sector, positions, {Q.rounded_list((*Q.MEASURES, *Q.SCENARIOS))}
FROM (SELECT sector, {Q.sums()} FROM batch GROUP BY sector)""")


def q_raw_book(spark, d):
    columns = raw_book(batch(spark, d))
    return rounded(columns)


S_RAW_BOOK = Q.with_book("""SELECT position_id, firm, desk, master_account, account, sector, industry,
  underlying, instrument_type, is_option, is_call, "right", strike, dte, expiry, qty, multiplier,
  underlying_price, round(iv, 4) AS iv, rate, round(div_yield, 4) AS div_yield, contract,
  round(sigma_daily, 4) AS sigma_daily FROM book""")


def _firm_batches(spark, d):
    """One stored batch for each of the five firms, without rollups.  The book is joined once, for all of them."""
    store = BatchStore(fresh_path(spark, "store"))
    with held(book(spark, d), "book") as positions:
        b = value_batch(positions, GRID)
        for firm in FIRMS:
            write_batch(b.where(F.col("firm") == firm), store, firm, f"{firm} 1", GRID, materialise=False)
    return store


def _every_firm(spark, store):
    frames = [load_batch(spark, store, firm, f"{firm} 1").frame.withColumn("read_as", F.lit(firm)) for firm in FIRMS]
    return reduce(DataFrame.unionByName, frames)


def q_load_batch(spark, d):
    loaded = _every_firm(spark, _firm_batches(spark, d))
    return rounded(loaded.groupBy("firm", "desk").agg(
        F.count(F.lit(1)).alias("positions"), *[F.sum(s).alias(s) for s in Q.SCENARIOS]))


S_LOAD_BATCH = Q.with_batch(f"""SELECT firm, desk, positions, {Q.rounded_list(Q.SCENARIOS)} FROM (
  SELECT firm, desk, {Q.sums(Q.SCENARIOS)} FROM batch GROUP BY firm, desk)""")


def q_list_batches(spark, d):
    store = _firm_batches(spark, d)
    b = load_batch(spark, store, "ASIA", "ASIA 1")
    write_batch(b.frame.where("is_option"), store, "ASIA", "ASIA 2", GRID, materialise=False)
    return list_batches(spark, store, "ASIA")


S_LIST_BATCHES = """SELECT r_name || ' ' || n AS batch_id FROM region, (VALUES (1), (2)) v(n)
WHERE r_name = 'ASIA'"""


def q_firm_scope(spark, d):
    """Each firm's reader sees its own positions only."""
    return _every_firm(spark, _firm_batches(spark, d)).groupBy("read_as", "firm").agg(
        F.count(F.lit(1)).alias("positions"), F.count_distinct("account").alias("accounts"))


S_FIRM_SCOPE = Q.with_book("""SELECT firm AS read_as, firm, count(*) AS positions, count(DISTINCT account) AS accounts
FROM book GROUP BY firm""")


def q_delete_batch(spark, d):
    """One firm's batch is deleted; the others stay."""
    store = _firm_batches(spark, d)
    delete_batch(spark, store, "ASIA", "ASIA 1")
    return reduce(DataFrame.unionByName, [list_batches(spark, store, firm) for firm in FIRMS])


S_DELETE_BATCH = "SELECT r_name || ' 1' AS batch_id FROM region WHERE r_name <> 'ASIA'"


def q_totals_from_rollup(spark, d):
    """The totals of a stored batch, folded from its rollups."""
    store = BatchStore(fresh_path(spark, "store"))
    write_batch(batch(spark, d), store, "ACME", "b1", GRID)
    return rounded(load_batch(spark, store, "ACME", "b1").totals(PivotRequest(("sector",))))


S_TOTALS_FROM_ROLLUP = Q.with_batch(f"""SELECT positions, {Q.rounded_list((*Q.MEASURES, *Q.SCENARIOS, 'worst'))}
FROM (SELECT *, {Q.WORST} AS worst FROM (SELECT {Q.sums()} FROM batch))""")


def q_export_csv(spark, d):
    """A report written in parts and read back."""
    path = fresh_path(spark, "report")
    export_csv(book(spark, d).groupBy("desk").agg(F.count(F.lit(1)).alias("positions")).orderBy("desk"), path)
    return spark.read.csv(path, header=True).select("desk", F.col("positions").cast("long").alias("positions"))


S_EXPORT_CSV = Q.with_book("SELECT desk, count(*) AS positions FROM book GROUP BY desk")


def q_ragged_source(spark, d):
    """Lines with a field too many fail the read, whatever is selected; lines with one too few are filled up."""
    n = table(spark, d, "nation").select(F.concat_ws(",", "n_nationkey", "n_name").alias("value"), "n_nationkey")
    out = []
    for name, tail in (("even", F.lit(",x")), ("short", F.lit("")), ("long", F.lit(",x,y"))):
        path = fresh_path(spark, name)
        lines = n.select(F.concat("value", F.when(F.col("n_nationkey") == 7, tail).otherwise(F.lit(",x"))).alias("value"))
        spark.createDataFrame([("key,name,more",)], "value string").unionByName(lines).coalesce(1).write.text(path)
        try:
            rows = read_source(spark, path).select("key").count()
        except SPARK_ERRORS:
            rows = -1
        out.append((name, rows))
    return spark.createDataFrame(out, "file string, rows long")


S_RAGGED_SOURCE = """SELECT f AS file, CASE WHEN f = 'long' THEN -1 ELSE n END AS "rows"
FROM (SELECT count(*) AS n FROM nation), (VALUES ('even'), ('short'), ('long')) v(f)"""


def q_dq_structure(spark, d):
    """An empty file, and one that lacks a required field."""
    b = book(spark, d)
    return findings(b.where("qty IS NULL AND qty = 0")).select(F.lit("empty").alias("file"), "severity", "code", "count").unionByName(
        findings(b.drop("qty")).where("code = 'missing_field'").select(F.lit("lacking").alias("file"), "severity", "code", "count"))


S_DQ_STRUCTURE = """SELECT f AS file, 'error' AS severity, c AS code, 0::BIGINT AS count
FROM (VALUES ('empty', 'empty_file'), ('lacking', 'missing_field')) v(f, c) WHERE (SELECT count(*) FROM lineitem) > 0"""


def q_ready_batches(spark, d):
    """All ready batches of a firm, newest first."""
    log = _registry(spark, d)
    first = log.agg(F.min("firm_id")).first()[0]
    return ready_batches(log, first).select("firm_id", "batch_id", "positions")


def q_pct_scenarios(spark, d):
    """Equities under the default percentage grid, ten moves by five shifts."""
    equities = book(spark, d).where("NOT is_option")
    grid = pct_grid()
    out = scenario_pnl(equities, grid)
    return rounded(out.groupBy("sector").agg(*[F.sum(column_of(i)).alias(column_of(i)) for i in range(len(grid))]), 2)


S_PCT_SCENARIOS = Q.with_book("SELECT sector, " + ", ".join(
    f"round(sum(qty * multiplier * underlying_price * {p.underlying!r}), 2) AS {column_of(i)}" for i, p in enumerate(pct_grid().points))
    + " FROM book WHERE NOT is_option GROUP BY sector")


def q_batch_manifest(spark, d):
    store = BatchStore(fresh_path(spark, "store"))
    write_batch(batch(spark, d), store, "ACME", "b1", GRID)
    m = load_batch(spark, store, "ACME", "b1").manifest
    rows = [(k, v, m["positions"], len(m["scenario_labels"])) for k, v in m["rollups"].items()]
    return spark.createDataFrame(rows, "dimension string, groups long, positions long, scenarios long")


S_BATCH_MANIFEST = Q.with_book("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, count(DISTINCT \"{c}\") AS groups, count(*) AS positions, "
    f"{len(GRID)}::BIGINT AS scenarios FROM book" for c in
    ("firm", "desk", "master_account", "account", "sector", "industry", "underlying",
     "instrument_type", "expiry", "strike", "right", "contract")) + ") WHERE groups <= 50000")


# -- registry -----------------------------------------------------------------


def _registry(spark, d):
    """Orders as registry entries: customer is the firm, priority the batch."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("firm_id"), F.col("o_orderpriority").alias("batch_id"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("positions"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ready").alias("status"),
        F.struct("o_orderdate", "o_orderkey").alias("recorded_at"))


def q_latest_batch(spark, d):
    rows = latest_ready(_registry(spark, d))
    return rows.select("firm_id", "batch_id", "positions",
                       F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


_LATEST = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)"""
S_LATEST_BATCH = f"""{_LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate DESC, o_orderpriority DESC) AS newest FROM l WHERE rn = 1 AND o_orderstatus <> 'F')
SELECT o_custkey::VARCHAR AS firm_id, o_orderpriority AS batch_id, o_orderkey AS positions,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM r WHERE newest = 1"""


def q_registry_latest(spark, d):
    rows = latest_entries(_registry(spark, d))
    return rows.select("firm_id", "batch_id", "positions", "status")


S_REGISTRY_LATEST = f"""{_LATEST} SELECT o_custkey::VARCHAR AS firm_id, o_orderpriority AS batch_id,
  o_orderkey AS positions, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ready' END AS status
FROM l WHERE rn = 1"""

S_READY_BATCHES = f"""{_LATEST} SELECT o_custkey::VARCHAR AS firm_id, o_orderpriority AS batch_id, o_orderkey AS positions
FROM l WHERE rn = 1 AND o_orderstatus <> 'F' AND o_custkey::VARCHAR = (SELECT min(o_custkey::VARCHAR) FROM orders)"""

QUERIES = {
    "delete_batch": (q_delete_batch, S_DELETE_BATCH),
    "dq_structure": (q_dq_structure, S_DQ_STRUCTURE),
    "export_csv": (q_export_csv, S_EXPORT_CSV),
    "pct_scenarios": (q_pct_scenarios, S_PCT_SCENARIOS),
    "ragged_source": (q_ragged_source, S_RAGGED_SOURCE),
    "ready_batches": (q_ready_batches, S_READY_BATCHES),
    "totals_from_rollup": (q_totals_from_rollup, S_TOTALS_FROM_ROLLUP),
    "scan_raw_text": (q_scan_raw_text, S_SCAN_RAW_TEXT),
    "scan_raw_parquet": (q_scan_raw_parquet, S_SCAN_RAW_PARQUET),
    "prepared_positions": (q_prepared_positions, S_PREPARED),
    "prepared_csv": (q_prepared_csv, S_PREPARED_CSV),
    "map_trim_upper": (q_map_trim_upper, S_MAP_TRIM_UPPER),
    "map_number": (q_map_number, S_MAP_NUMBER),
    "map_scale": (q_map_scale, S_MAP_SCALE),
    "map_abs_negate": (q_map_abs_negate, S_MAP_ABS_NEGATE),
    "map_signed_by": (q_map_signed_by, S_MAP_SIGNED_BY),
    "map_call_put": (q_map_call_put, S_MAP_CALL_PUT),
    "map_date": (q_map_date, S_MAP_DATE),
    "map_values": (q_map_values, S_MAP_VALUES),
    "apply_profile": (q_apply_profile, S_APPLY_PROFILE),
    "finalise": (q_finalise, S_FINALISE),
    "contract_label": (q_contract_label, S_CONTRACT_LABEL),
    "position_id": (q_position_id, S_POSITION_ID),
    "sigma_from": (q_sigma_from, S_SIGMA_FROM),
    "inspect_source": (q_inspect_source, S_INSPECT_SOURCE),
    "mapping_preview": (q_mapping_preview, S_MAPPING_PREVIEW),
    "quarantine_bytes": (q_quarantine_bytes, S_QUARANTINE_BYTES),
    "stream_many_files": (q_stream_many_files, S_STREAM_MANY_FILES),
    "ingest_by_profile": (q_ingest_by_profile, S_INGEST_BY_PROFILE),
    "run_log": (q_run_log, S_RUN_LOG),
    "latest_profile": (q_latest_profile, S_LATEST_PROFILE),
    "dq_findings": (q_dq_findings, S_DQ_FINDINGS),
    "dq_row_drift": (q_dq_row_drift, S_DQ_ROW_DRIFT),
    "dq_accounts": (q_dq_accounts, S_DQ_ACCOUNTS),
    "ingest_gate": (q_ingest_gate, S_INGEST_GATE),
    "quarantine": (q_quarantine, S_QUARANTINE),
    "stream_drop_ingest": (q_stream_drop_ingest, S_STREAM_DROP_INGEST),
    "raw_book": (q_raw_book, S_RAW_BOOK),
    "cold_positions": (q_cold_positions, S_COLD_POSITIONS),
    "load_batch": (q_load_batch, S_LOAD_BATCH),
    "list_batches": (q_list_batches, S_LIST_BATCHES),
    "firm_scope": (q_firm_scope, S_FIRM_SCOPE),
    "batch_manifest": (q_batch_manifest, S_BATCH_MANIFEST),
    "latest_batch": (q_latest_batch, S_LATEST_BATCH),
    "registry_latest": (q_registry_latest, S_REGISTRY_LATEST),
}
