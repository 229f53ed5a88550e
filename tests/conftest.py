from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremor.operators.scenarios import ShockConfig
from tremor.operators.valuation import value_batch
from tremor.plans.book import book

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tremor-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def positions(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("book"))
    book(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def batch(spark, positions, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batch"))
    value_batch(positions, ShockConfig().grid()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def pdf(batch):
    return batch.toPandas()


@pytest.fixture
def raw(spark):
    """Six lines of a made-up clearing file, all text: futures house codes, lots, prices in cents."""
    lines = """
    17|zinc | 12    |bought|call  |2500|2026-04-17|$25.50 |40   |metals
    18|zinc | 7     |sold  |put   |2250|2026-04-17|25.50  |41.5 |metals
    17|rye  | 1,000 |sold  |future|    |          |8.25   |     |grain
    19|rye  | (40)  |bought|put   |775 |17-Jul-2026|8.25  |22   |grain
    19|opal | 3     |bought|call  |9050|20261218  |90     |65   |gems
    20|opal |       |bought|future|    |          |90     |     |gems
    """
    rows = [tuple(cell for cell in line.strip().split("|")) for line in lines.strip().splitlines()]
    columns = ["house", "product", "lots", "way", "what", "strike cents", "until", "last", "vol", "group"]
    return spark.createDataFrame(rows, columns).coalesce(1)
