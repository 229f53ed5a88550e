"""Tables and shuffle files on the way are gone when a job is done."""

from __future__ import annotations

import datetime as dt
import glob
import os
import time

import pytest
from py4j.protocol import Py4JJavaError

from tremor.operators.ingest import Workspace, ingest_file
from tremor.operators.ingest_many import ingest_files
from tremor.plans.raw_export import profile, raw_export
from tremor.session import held, move_path, shared_folder, tune
from tremor.sources.batch_store import BatchStore, write_batch
from tremor.operators.scenarios import ShockConfig

from conftest import SF

DAY = dt.date(2026, 1, 15)


def kept(spark) -> set[str]:
    """Tables in the shared folder, but for those of one row a split."""
    return {n for n in os.listdir(shared_folder(spark)) if not n.startswith("splits-")} if os.path.isdir(shared_folder(spark)) else set()


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("drop") / "x")
    raw_export(spark, SF).limit(300).coalesce(1).write.option("header", True).csv(path)
    return path


@pytest.mark.parametrize("many", [False, True])
def test_ingest_leaves_its_workspace_only(spark, file, tmp_path, many):
    before, work = kept(spark), Workspace(str(tmp_path / "w"))
    run = ingest_files(spark, work, profile(), [(file, "b")], DAY)[0] if many else ingest_file(spark, work, profile(), file, "b", DAY)
    assert run["status"] == "succeeded" and run["rows"] == 300
    assert kept(spark) == before


def test_a_store_leaves_its_batch_only(spark, batch, tmp_path):
    before = kept(spark)
    write_batch(batch, BatchStore(str(tmp_path / "s")), "A", "b", ShockConfig().grid())
    assert kept(spark) == before


def test_shuffle_files_go_with_their_query(spark, tmp_path):
    tune(spark)
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    found = lambda: {f for d in place for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = found()
    spark.range(10_000).selectExpr("id % 100 AS k").groupBy("k").count().write.parquet(str(tmp_path / "o"))
    # Files are removed behind the query's back.
    until = time.monotonic() + 20
    while found() - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not found() - before


def test_held_and_moved(spark, tmp_path):
    before = kept(spark)
    with held(spark.range(5), "five") as five:
        assert five.count() == 5 and kept(spark) != before
        five.write.parquet(str(tmp_path / "a"))
    assert kept(spark) == before
    move_path(spark, str(tmp_path / "a"), str(tmp_path / "b/c"))
    assert spark.read.parquet(str(tmp_path / "b/c")).count() == 5
    with pytest.raises((OSError, Py4JJavaError)):
        move_path(spark, str(tmp_path / "none"), str(tmp_path / "d"))
