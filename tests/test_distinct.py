"""Foldable distinct counts against plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.operators.distinct import bitmaps, counted, dictionary, folded, level_counts


def test_codes_are_dense_in_order_of_the_values(spark):
    df = spark.createDataFrame([("b", 1.0), (None, 2.5), ("a", None), ("b", 1.0)], "x string, y double")
    rows = sorted((r["detail"], r["code"], r["value"]) for r in dictionary(df, ["x", "y"]).collect())
    assert rows == [("x", 1, None), ("x", 2, "a"), ("x", 3, "b"), ("y", 1, None), ("y", 2, "1.0"), ("y", 3, "2.5")]


def test_more_codes_than_a_bucket_holds(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("x"), F.lit(None).cast("string").alias("y"))
    codes = dictionary(df, ["x", "y"])
    assert codes.where("detail = 'x'").agg(F.min("code"), F.max("code"), F.count_distinct("code")).first() == (1, 100_000, 100_000)
    maps = bitmaps(df, ["k"], ["x", "y"], codes)
    assert sorted(tuple(r) for r in counted(maps, ["k"], ["x", "y"]).collect()) == [(0, 33_334, 1), (1, 33_333, 1), (2, 33_333, 1)]
    assert tuple(counted(folded(maps, []), [], ["x", "y"]).first()) == (100_000, 1)


def test_levels_and_batches_fold(spark, batch):
    details, levels = ["underlying", "right", "strike"], [("firm", "desk", "account"), ("firm", "desk"), ("firm",)]
    odd = batch.withColumn("right", F.when(F.col("right") != "-", F.col("right")))
    codes = dictionary(odd, details)
    plain = lambda df, keys: {tuple(r[k] for k in keys): tuple(r[f"n{d}"] for d in details) for d0 in [0] for r in df.groupBy(*keys).agg(*[
        (F.count_distinct(d) + F.max(F.col(d).isNull().cast("int"))).alias(f"n{d}") for d in details]).collect()}
    calls, others = odd.where("`right` = 'C'"), odd.where("`right` is null or `right` <> 'C'")
    both = bitmaps(calls, levels[0], details, codes).unionByName(bitmaps(others, levels[0], details, codes))
    got = level_counts(folded(both, levels[0]), levels, details).collect()
    for keys in levels:
        mine = {tuple(r[k] for k in keys): tuple(r[f"{d}__n"] for d in details) for r in got if r["level"] == len(keys)}
        assert mine == plain(odd, keys)


def test_a_value_takes_one_word(spark):
    """What a fine group of one value takes does not grow with the dictionary; the highest bit of a word counts too."""
    df = spark.range(1_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("x"))
    maps = bitmaps(df, ["k"], ["x"], dictionary(df, ["x"]))
    assert dict(maps.dtypes)["bitmap"] == "bigint" and maps.count() == 1_000
    assert [r["x__n"] for r in counted(maps, ["k"], ["x"]).collect()] == [1] * 1_000
    assert counted(folded(maps, []), [], ["x"]).first()[0] == 1_000
