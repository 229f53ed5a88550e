from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.functions.listed import listed_expiry, strike_step, third_friday
from tremor.functions.text import number_text, strike_label
from tremor.functions.transforms import TRANSFORMS, MappingContext, parsed_date
from tremor.session import SPARK_ERRORS
from tremor.operators.identity import with_position_id
from tremor.operators.mapping import (FieldMapping, MappingError, Profile, apply_profile, finalise,
                                      inspect_source, latest_profile, next_version, resolve_sigma)
from tremor.sources.positions import read_positions
from tremor.sources.text import read_source

DAY = dt.date(2026, 2, 2)
CTX = MappingContext(DAY, ("x", "side"))
# Canonical field -> (file column, transform, parameters).
FIELDS = {
    "account": ("house", "trim", {}),
    "sector": ("group", "map_values", {"values": {"metals": "Metals", "grain": "Grain"}, "default": "Rest"}),
    "underlying": ("product", "upper", {}),
    "expiry": ("until", "date", {}),
    "right": ("what", "call_put", {}),
    "strike": ("strike cents", "scale", {"factor": 0.01}),
    "qty": ("lots", "signed_by", {"side_column": "way", "short_values": ["sold"]}),
    "iv": ("vol", "scale", {"factor": 0.01}),
    "underlying_price": ("last", "number", {}),
}


def profile(without=(), **replaced) -> Profile:
    """The clearing file's profile; ``replaced`` maps fields (or any names) to mappings of their own."""
    usual = {f: FieldMapping(f, c, transform=t, params=p) for f, (c, t, p) in FIELDS.items() if f not in without}
    return Profile("HOUSE", mappings=[*(usual | replaced).values()])


def test_clearing_file(raw):
    got = apply_profile(raw, profile(), DAY, number=False).toPandas()
    signed = [12.0, -7.0, -1000.0, 40.0, 3.0]
    assert list(got["qty"][:5]) == signed and np.isnan(got["qty"][5])
    assert list(got["right"]) == ["C", "P", "-", "P", "C", "-"]
    assert list(got["expiry"].fillna("")) == ["2026-04-17", "2026-04-17", "", "2026-07-17", "2026-12-18", ""]
    assert list(got["dte"]) == [(dt.date.fromisoformat(e) - DAY).days if e else 0 for e in got["expiry"].fillna("")]
    assert np.allclose(got["strike"].fillna(0), [25, 22.5, 0, 7.75, 90.5, 0]) and np.allclose(got["iv"].dropna(), [0.4, 0.415, 0.22, 0.65])
    assert list(got["contract"]) == ["ZINC 2026-04-17 25C", "ZINC 2026-04-17 22.5P", "RYE", "RYE 2026-07-17 7.75P", "OPAL 2026-12-18 90.5C", "OPAL"]
    option = np.array([True, True, False, True, True, False])
    assert (got["is_option"] == option).all() and (got["multiplier"] == np.where(option, 100, 1)).all()
    assert list(got["sector"]) == ["Metals"] * 2 + ["Grain"] * 2 + ["Rest"] * 2
    # What nobody maps gets the defaults; the master account is the account.
    assert (got["master_account"] == got["account"]).all() and got["rate"].unique().tolist() == [0.042]
    assert {c: got[c].unique().tolist() for c in ("firm", "desk", "industry")} == {"firm": ["FIRM"], "desk": ["UNASSIGNED"], "industry": ["Unclassified"]}


def test_a_misfit_lists_all_its_problems(raw):
    bad = profile(
        without=("account",), strike=FieldMapping("strike", "cents"), extra=FieldMapping("colour", "group", transform="paint"),
        dte=FieldMapping("dte"), again=FieldMapping("qty", "lots"), rate=FieldMapping("rate", constant="high"))
    with pytest.raises(MappingError) as caught:
        apply_profile(raw, bad, DAY)
    assert {(p.code, p.field, p.detail) for p in caught.value.problems} == {
        ("column_not_in_file", "strike", "cents"), ("field_not_canonical", "colour", ""), ("no_such_transform", "colour", "paint"),
        ("nothing_to_map", "dte", ""), ("mapped_twice", "qty", ""), ("required_not_mapped", "account", ""),
        ("constant_of_other_type", "rate", "'high'")}
    assert str(caught.value).count("(") == 7


def test_a_side_needs_its_column(raw):
    for params in ({}, {"side_column": "direction"}):
        with pytest.raises(ValueError):
            apply_profile(raw, profile(qty=FieldMapping("qty", "lots", transform="signed_by", params=params)), DAY)


def run(spark, name, texts, **params):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, x string")
    out = df.select("i", TRANSFORMS[name](F.col("x"), params, CTX).alias("y"))
    return [r["y"] for r in out.orderBy("i").collect()]


def test_numbers(spark):
    texts = ["1,234.5", "(1,234)", "$5", "+7", " 8 ", "abc", "1d", "", None, "-3", "1e3", "( 2 )", "--1"]
    assert run(spark, "number", texts) == [
        1234.5, -1234, 5, 7, 8, None, None, None, None, -3, 1000, -2, None]
    assert run(spark, "scale", ["30"], factor=0.01) == [0.3] and run(spark, "scale", ["30"]) == [30]
    assert run(spark, "abs", ["(5)"]) == [5] and run(spark, "negate", ["(5)", "2"]) == [5, -2]


def test_text_transforms(spark):
    assert run(spark, "trim", ["\t a b \n", "\u00a0\u2003x\u3000"]) == ["a b", "x"] and run(spark, "upper", [" ab\t"]) == ["AB"]
    assert run(spark, "identity", [" x "]) == [" x "]
    assert run(spark, "call_put", ["c", " PUT", "1", "0", "-1", "x", None]) == list("CPCPP--")
    assert run(spark, "map_values", [" EQ ", "FX", None], values={"EQ": "Equities"}, default="?") == [
        "Equities", "?", "?"]
    assert run(spark, "map_values", ["EQ", "FX"], values={"EQ": "Equities"}) == ["Equities", None]


def test_signed_by(spark):
    df = spark.createDataFrame([("5", "SELL"), ("(5)", " short"), ("5", "B"), ("5", None)], "x string, side string")
    out = df.select(TRANSFORMS["signed_by"](F.col("x"), {"side_column": "side"}, CTX).alias("y"))
    assert [r["y"] for r in out.collect()] == [-5, -5, 5, 5]


def test_dates(spark):
    texts = ["2026-03-20", "03/20/2026", "3/2/2026", "20/03/2026", "20260320", "20-Mar-2026",
             "03/20/26", "2026-02-30", "soon", "", None]
    assert run(spark, "date", texts) == [
        "2026-03-20", "2026-03-20", "2026-03-02", "2026-03-20", "2026-03-20", "2026-03-20",
        "2026-03-20", None, None, None, None]
    assert run(spark, "date", ["03/04/2026"]) == ["2026-03-04"]  # month first
    assert run(spark, "date", ["03/04/2026"], format="%d/%m/%Y") == ["2026-04-03"]
    with pytest.raises(ValueError):
        parsed_date(F.lit("x"), "%Q")


def test_labels(spark):
    df = spark.createDataFrame([(147.0,), (147.5,), (147.25,), (12345678.0,), (0.1,)], "k double")
    assert [r[0] for r in df.select(strike_label(F.col("k"))).collect()] == [
        "147", "147.5", "147.25", "12345678", "0.1"]
    assert [r[0] for r in df.select(number_text(F.col("k"))).collect()] == [
        "147.0", "147.5", "147.25", "12345678.0", "0.1"]


def test_finalise_derivations(spark):
    df = spark.createDataFrame(
        [("a", "X", 1.0, 10.0, "45", 50.0), ("a", "X", 1.0, 10.0, "2026-01-10", 50.0),
         ("a", "X", 1.0, 10.0, "weird", 50.0), ("a", "X", 1.0, 10.0, None, None)],
        "account string, underlying string, qty double, underlying_price double, expiry string, strike double")
    out = finalise(df, DAY).toPandas()
    assert list(out["dte"]) == [45, 0, 0, 0]
    assert list(out["instrument_type"]) == ["OPTION", "OPTION", "OPTION", "EQUITY"]
    assert out["contract"][3] == "X"
    lower = finalise(df.withColumns({"instrument_type": F.lit("option"), "right": F.lit("c")}), DAY)
    row = lower.first()
    assert row["is_option"] and row["is_call"]


def test_sigma(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(0.2, 0.02), (0.3, nan), (0.0, None)], "iv double, sigma_daily double")
    out = resolve_sigma(df).toPandas()
    assert out["sigma_supplied"].all() and list(out["sigma_daily"]) == [0.02, 0.01, 0.01]
    for useless in ([0.0, 0.0], [nan, nan], [inf, nan], [-1.0, 0.0]):
        bad = spark.createDataFrame([(0.2, useless[0]), (None, useless[1])], "iv double, sigma_daily double")
        got = resolve_sigma(bad).toPandas()
        assert not got["sigma_supplied"].any()
        assert np.allclose(got["sigma_daily"], [0.2 / 252 ** 0.5, 0.01 / 252 ** 0.5])
    assert resolve_sigma(df.select(F.lit(1).alias("x"))).first()["sigma_daily"] == pytest.approx(0.3 / 252 ** 0.5)


def test_position_ids_follow_file_order(spark, tmp_path):
    """Several files and splits smaller than a file."""
    folder = tmp_path / "in"
    folder.mkdir()
    for name, start in (("a", 0), ("b", 5000), ("c", 10000)):
        (folder / f"{name}.csv").write_text(
            "n,pad\n" + "".join(f"{i},{'x' * 50}\n" for i in range(start, start + 5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    try:
        df = with_position_id(spark.read.csv(str(folder), header=True))
        assert df.where("position_id <> cast(n as long)").count() == 0
        assert df.count() == 15000
        per = with_position_id(spark.read.csv(str(folder), header=True), "i", per_file=True)
        assert per.where("i <> cast(n as long) % 5000").count() == 0
        plan = df._jdf.queryExecution().toString()
        assert "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_read_source_options(spark, tmp_path):
    plain = tmp_path / "p.csv"
    plain.write_text('id,v,w\n007,NA,"a, ""b"""\n008,1.50,\n')
    rows = read_source(spark, plain).collect()
    assert [tuple(r) for r in rows] == [("007", None, 'a, "b"'), ("008", "1.50", None)]
    kept = read_source(spark, plain, options={"null_values": ["1.50"]}).collect()
    assert [r["v"] for r in kept] == ["NA", None]
    odd = tmp_path / "o.csv"
    odd.write_bytes("made by x\n\nid;v\n1;café\n2;b\n".encode("latin-1"))
    got = read_source(spark, odd, options={
        "separator": ";", "skip_rows": 2, "encoding": "ISO-8859-1"}).collect()
    assert [tuple(r) for r in got] == [("1", "café"), ("2", "b")]
    ragged = tmp_path / "r.csv"
    ragged.write_text("id,v\n1,a,extra\n2,b\n")
    for use in (lambda df: df.collect(), lambda df: df.select("id").collect(), lambda df: df.count()):
        with pytest.raises(SPARK_ERRORS):
            use(read_source(spark, ragged))
    short = tmp_path / "s.csv"
    short.write_text('id,v\n1\n2,"b\nc"\n')
    filled = read_source(spark, short, options={"multi_line": True}).collect()
    assert [tuple(r) for r in filled] == [("1", None), ("2", "b\nc")]
    cut = read_source(spark, ragged, options={"truncate_ragged_lines": True}).collect()
    assert [tuple(r) for r in cut] == [("1", "a"), ("2", "b")]


def test_prepared_positions(spark, positions, tmp_path):
    path = str(tmp_path / "prepared")
    positions.drop("sigma_daily").write.option("header", True).csv(path)
    back = read_positions(spark, path, "csv")
    assert dict(back.dtypes)["strike"] == "double" and dict(back.dtypes)["is_option"] == "boolean"
    a = back.toPandas().sort_values("position_id", ignore_index=True)
    b = positions.toPandas().sort_values("position_id", ignore_index=True)
    assert np.allclose(a["sigma_daily"], b["sigma_daily"]) and list(a["account"]) == list(b["account"])


def test_inspect_source(raw):
    rows = {r["column"]: r for r in inspect_source(raw).collect()}
    assert rows["product"]["samples"] == ["zinc ", "zinc ", "rye  "] and rows["product"]["rows"] == 6


def test_profile_versions(spark):
    empty = spark.createDataFrame([], "firm_id string, name string, body string, version int, active boolean")
    fresh = spark.createDataFrame([("A", "p", "one"), ("A", "q", "one")], "firm_id string, name string, body string")
    first = next_version(empty, fresh)
    second = next_version(first, fresh.where("name = 'p'").withColumn("body", F.lit("two")))
    assert second.count() == 3 and second.where("active").count() == 2
    best = {r["name"]: (r["version"], r["body"]) for r in latest_profile(second).collect()}
    assert best == {"p": (2, "two"), "q": (1, "one")}
    assert Profile.from_dict(profile().to_dict()) == profile()


def test_listed_helpers(spark):
    df = spark.createDataFrame([(dt.date(2026, m, 1),) for m in range(1, 13)], "d date")
    thirds = [r[0] for r in df.select(third_friday(F.col("d"))).collect()]
    assert all(x.weekday() == 4 and 15 <= x.day <= 21 for x in thirds)
    days = spark.createDataFrame(
        [(dt.date(2026, 1, 1) + dt.timedelta(days=i), t) for i in range(60) for t in (0, 1, 7, 29, 30, 45, 400)],
        "d date, t int")
    for r in days.select("d", "t", listed_expiry(F.col("d"), F.col("t")).alias("e")).collect():
        assert r["e"] > r["d"] and r["e"].weekday() == 4
        assert r["t"] < 30 or 15 <= r["e"].day <= 21
    steps = spark.createDataFrame([(9.99,), (10.0,), (99.0,), (250.0,), (1000.0,)], "p double")
    assert [r[0] for r in steps.select(strike_step(F.col("p"))).collect()] == [0.5, 1.0, 2.5, 10.0, 50.0]
