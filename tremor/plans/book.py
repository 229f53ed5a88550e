"""A position book derived from the order tables.

Line items become positions, customers accounts, parts underlyings.  All join
strategies are left to the optimizer's size checks.  An order's account is joined
to it before its lines are, so that the lines are shuffled for their parts and
their orders alone, and the wide account texts never for the parts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.identity import with_position_id
from ..operators.scenarios import ShockConfig
from ..operators.valuation import value_batch
from ..session import spread

BATCH_DATE = dt.date(2026, 1, 15)
GRID = ShockConfig().grid()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical positions with ids in file order."""
    lines = spread(with_position_id(table(spark, sf_dir, "lineitem")), "position_id")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    owned = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
    )
    option = F.col("l_returnflag") != "N"
    price = F.col("p_retailprice")
    zero = F.lit(0.0)
    strike = F.round(price * (F.lit(0.8) + F.lit(4.0) * F.col("l_discount")) / 10) * 10
    life = 1 + F.abs(F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))) % 730
    base = joined.select(
        "position_id",
        F.col("r_name").alias("firm"), F.col("n_name").alias("desk"),
        F.concat_ws("-", "n_name", "c_mktsegment").alias("master_account"),
        F.col("c_name").alias("account"),
        F.col("p_type").alias("sector"), F.col("p_brand").alias("industry"),
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("underlying"),
        F.when(option, "OPTION").otherwise("EQUITY").alias("instrument_type"),
        option.alias("is_option"),
        (option & (F.col("l_linestatus") == "O")).alias("is_call"),
        F.when(~option, "-").when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("right"),
        F.when(option, strike).otherwise(zero).alias("strike"),
        F.when(option, life.cast("double")).otherwise(zero).alias("dte"),
        F.when(option, F.date_format(F.date_add(F.lit(BATCH_DATE), life.cast("int")), "yyyy-MM-dd"))
        .otherwise("-").alias("expiry"),
        F.when(F.col("l_linenumber") % 2 == 0, -F.col("l_quantity"))
        .otherwise(F.col("l_quantity")).alias("qty"),
        F.when(option, F.lit(100.0)).otherwise(F.lit(1.0)).alias("multiplier"),
        price.alias("underlying_price"),
        F.when(option, F.lit(0.15) + F.lit(5.0) * F.col("l_tax")).otherwise(zero).alias("iv"),
        F.lit(0.042).alias("rate"), (F.col("l_discount") / 4).alias("div_yield"),
    )
    contract = F.concat_ws(
        " ", "underlying", "expiry", F.concat(F.col("strike").cast("long").cast("string"), "right"))
    return base.withColumns({
        "contract": F.when(F.col("is_option"), contract).otherwise(F.col("underlying")),
        "sigma_daily": F.greatest(F.col("iv"), F.lit(0.01)) / F.sqrt(F.lit(252.0)),
    })


def batch(spark: SparkSession, sf_dir: str, grid=GRID) -> DataFrame:
    """The valued book: greeks and one P&L column per scenario."""
    return value_batch(book(spark, sf_dir), grid)
