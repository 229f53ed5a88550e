"""Headline timings: one JSON line on standard output.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The matrix build is given cold and warm; queries on the stored batch are the best
of three after a warm-up run, each a block of at most 100 rows as a grid asks for.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremor.operators.flatten import flatten
from tremor.operators.pivot import PivotRequest, pivot, pivot_by, totals
from tremor.operators.quality import findings
from tremor.operators.rollup import rollups
from tremor.operators.scenarios import sigma_grid
from tremor.operators.valuation import scenario_pnl, value_batch
from tremor.plans.book import BATCH_DATE, book
from tremor.plans.raw_export import profile, raw_export
from tremor.operators.mapping import apply_profile
from tremor.sources.batch_store import BatchStore, load_batch, load_positions, write_batch
from tremor.session import tune
from tremor.sources.text import read_source

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("tremor-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tremor-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    folder = spark.conf.get("spark.checkpoint.dir")
    seconds: dict[str, float] = {}

    # The book is input data here, as the reference's generator output is.
    positions = f"{folder}/book"
    book(spark, SF_DIR).write.parquet(positions)
    source = spark.read.parquet(positions)
    rows = source.count()
    grid = sigma_grid()
    store = BatchStore(f"{folder}/store")

    seconds["matrix_build_50_cold"] = timed(lambda: drain(scenario_pnl(source, grid)))
    seconds["matrix_build_50"] = min(
        timed(lambda: drain(scenario_pnl(source, grid))) for _ in range(2))
    seconds["build_and_store_batch"] = timed(
        lambda: write_batch(value_batch(source, grid), store, "ACME", "b", grid, materialise=False))
    seconds["store_rollups"] = timed(
        lambda: write_batch(load_batch(spark, store, "ACME", "b").frame, store, "ACME", "r", grid))
    stored = load_batch(spark, store, "ACME", "b")
    # The same without the second copy of the batch that the entry above writes.
    seconds["rollups_alone"] = timed(lambda: drain(rollups(stored.frame)))
    rolled = load_batch(spark, store, "ACME", "r")
    frame = stored.frame

    export = f"{folder}/export"
    raw_export(spark, SF_DIR).write.option("header", True).csv(export)

    def ask(batch, *dims, limit=100, **more):
        request = PivotRequest(dims, limit=limit, **more)
        return lambda: batch.pivot(request).rows.collect()

    queries = {
        "pivot_sector": ask(stored, "sector"),
        "pivot_desk": ask(stored, "desk"),
        "pivot_underlying": ask(stored, "underlying"),
        "pivot_desk_account": lambda: pivot_by(frame, ["desk", "account"]).collect(),
        "pivot_expiry_strike": lambda: pivot_by(frame, ["expiry", "strike"]).collect(),
        "pivot_four_details": ask(stored, "sector", detail_dimensions=(
            "desk", "account", "underlying", "right")),
        "pivot_contract_page": ask(stored, "contract", sort=(("worst", False),)),
        "drill_one_node": ask(stored, "firm", "desk", "account", path=(("firm", "ASIA"),)),
        "leaf_page": ask(stored, "account", path=(("account", "Customer#000000255"),)),
        "totals": lambda: totals(frame, PivotRequest(("desk",))).collect(),
        "totals_from_rollup": lambda: rolled.totals(PivotRequest(("desk",))).collect(),
        "one_scenario": lambda: frame.groupBy("sector").agg(F.sum("s022")).collect(),
        "rollup_sector": ask(rolled, "sector"),
        "tree_three_levels": lambda: flatten(frame, PivotRequest(("firm", "desk", "account")), 3, 500).collect(),
        "map_and_validate": lambda: findings(
            apply_profile(read_source(spark, export), profile(), BATCH_DATE)).collect(),
        "reprice_cold_book_20": lambda: drain(scenario_pnl(
            load_positions(spark, store, "ACME", "b"), sigma_grid((-2.0, -1.0, 1.0, 2.0)))),
    }
    for name, run in queries.items():
        run()
        seconds[name] = min(timed(run) for _ in range(3))

    seconds = {k: round(v, 4) for k, v in seconds.items()}
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "positions": rows,
        "million_reprices_per_second": round(rows * 50 / seconds["matrix_build_50"] / 1e6, 2),
    }))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
