"""Drop-directory ingest: as a Structured Streaming query, and as a poll of what waits."""

from __future__ import annotations

import datetime as dt
import json
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import RUNS, Workspace, read_table
from ..operators.ingest_many import ingest_files
from ..operators.mapping import Profile, latest_profile
from ..sources.text import local_name

FILES_PER_TRIGGER = 10
_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*",
             limit: int = FILES_PER_TRIGGER, archive: str | None = None) -> DataFrame:
    """New files of a folder, oldest first, a bounded number per micro-batch.

    Only paths are selected, so contents are not read here.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(_FILE)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", limit)
        .option("latestFirst", "false")
    )
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).select("path", "modificationTime")


def fixed_part(folder: str) -> str:
    """The folders before the first pattern of a path."""
    parts = folder.rstrip("/").split("/")
    cut = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[{")), len(parts))
    return "/".join(parts[:cut])


def identified(files: DataFrame, folder: str) -> DataFrame:
    """Listed files with ``batch``: the path under the drop folder, and when it was written in microseconds.

    The same for a replay; another for a file of that name in another folder, and for a file
    that comes again under the same name.
    """
    root = F.lit(quote(local_name(fixed_part(folder)), safe="/:@!$&'()*+,;=~") + "/")
    place = F.instr("path", root)
    name = F.when(place > 0, F.substr("path", place + F.length(root))).otherwise(F.col("path"))
    return files.select("path", "modificationTime", F.concat(name, F.lit("@"), F.unix_micros("modificationTime").cast("string")).alias("batch"))


def _take(files: DataFrame, work: Workspace, profile: Profile, batch_date: dt.date, rules) -> int:
    """Ingest identified files together, in the order of their times; one row a file comes to the driver."""
    taken = [(local_name(r["path"]), r["batch"]) for r in files.orderBy("modificationTime", "path").collect()]
    if taken:
        ingest_files(files.sparkSession, work, profile, taken, batch_date, rules=rules)
    return len(taken)


# Stored profiles: the mapping itself is JSON, and files of the firm are those whose place matches the pattern.
PROFILES = "firm_id string, name string, version int, active boolean, pattern string, profile string"


def stored_profile(profile: Profile, pattern: str, version: int = 1, active: bool = True) -> tuple:
    """A row of the stored profiles; ``pattern`` is a regular expression on the path under the drop folder."""
    return profile.firm_id, profile.name, version, active, pattern, json.dumps(profile.to_dict())


def claimed(files: DataFrame, saved: DataFrame) -> DataFrame:
    """Identified files beside the newest active profile of a firm whose pattern they match, the first by firm and name.

    Stored profiles are a row for each that someone drew up, so they are held against every file as they are.
    """
    newest = F.broadcast(latest_profile(saved))
    met = files.join(newest, F.expr("batch rlike pattern"))
    first = F.min_by(F.struct("firm_id", "name", "version", "profile"), F.struct("firm_id", "name")).alias("p")
    return met.groupBy("path", "modificationTime", "batch").agg(first).select("path", "modificationTime", "batch", "p.*")


def _take_by_profile(files: DataFrame, work: Workspace, saved: DataFrame, batch_date: dt.date, rules) -> int:
    """Ingest identified files by the stored profiles: those of one profile together."""
    groups: dict[tuple, list] = {}
    n = 0
    for r in claimed(files, saved).orderBy("modificationTime", "path").collect():
        groups.setdefault((r["firm_id"], r["profile"], r["version"]), []).append((local_name(r["path"]), r["batch"]))
        n += 1
    for (_, text, version), taken in groups.items():
        profile = Profile.from_dict(json.loads(text) | {"version": version})
        ingest_files(files.sparkSession, work, profile, taken, batch_date, rules=rules.get(profile.firm_id, ()) if isinstance(rules, dict) else rules)
    return n


def drop_ingest(spark: SparkSession, folder: str, work: Workspace, profile: Profile,
                batch_date: dt.date, checkpoint: str, pattern: str = "*.csv",
                limit: int = FILES_PER_TRIGGER, archive: str | None = None,
                rules=()) -> StreamingQuery:
    """Ingest every waiting file, then stop; restart to pick up later ones.

    The checkpoint remembers which paths were taken, ``limit`` bounds the files of a micro-batch
    that is planned from now on, and a micro-batch that is replayed takes all its files, however
    many, into the same batches.  A file that comes again under a path that was taken is not new
    to a stream: ``poll`` finds it.
    """

    def each(files: DataFrame, epoch: int) -> None:
        _take(identified(files, folder), work, profile, batch_date, rules)

    return (
        arrivals(spark, folder, pattern, limit, archive).writeStream
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drop_by_profiles(spark: SparkSession, folder: str, work: Workspace, profiles: str, batch_date: dt.date, checkpoint: str,
                     pattern: str = "*.csv", limit: int = FILES_PER_TRIGGER, archive: str | None = None, rules=()) -> StreamingQuery:
    """``drop_ingest`` for all firms that have a stored profile, in the table ``profiles``.

    The profiles are read anew for each micro-batch, so a version that is saved between two drops
    counts from the second on.  A file that no active profile claims is left where it is.  ``rules`` are for
    all firms, or a dictionary of them by firm.
    """

    def each(files: DataFrame, epoch: int) -> None:
        saved = files.sparkSession.read.schema(PROFILES).parquet(profiles)
        _take_by_profile(identified(files, folder), work, saved, batch_date, rules)

    return (
        arrivals(spark, folder, pattern, limit, archive).writeStream
        .foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def poll(spark: SparkSession, folder: str, work: Workspace, profile: Profile, batch_date: dt.date,
         pattern: str = "*.csv", rules=()) -> int:
    """Ingest the files that no run of this firm has recorded, by path and time; returns how many.

    The run log is the memory, so a file that replaces one of the same name is taken too.
    """
    listed = spark.read.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    done = read_table(spark, work.table("runs"), f"{RUNS}, key string").where(F.col("firm_id") == profile.firm_id).select(F.col("key").alias("taken"))
    fresh = identified(listed, folder).join(done, F.col("batch") == F.col("taken"), "left_anti")
    return _take(fresh, work, profile, batch_date, rules)
