"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when identical after every run of ``[\\x20\\x09-\\x0D]`` became one space.  A
text's key is the head of its SHA-256.  The directory maps the leading bits of a key to a
bucket, that is, a key range; it starts as one bucket and doubles where an overfull bucket has
used up its bits.  Only counts of distinct keys under each prefix reach the driver, ``2 **
MAX_DEPTH`` of them at most.  Every owner task has buckets that lie side by side, that is a range of
keys, goes over them in order, chains what shares a key and compares the bytes of every text with
the chain, so colliding keys stay apart.

Only rows that share a key have their texts moved.  A key with many rows is salted: the parts
but the first are chained by other tasks, and each sends one text a link on to the owner.

Null texts count as empty.  A null doc_id comes after all others: it stays only among its like.
Rows that repeat a doc_id and an equal text count each in ``group_size`` and are kept or dropped
together.  An empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, small, written
from .common import hands, mapped, record

# Keys a bucket holds before it splits, bits the directory may use, rows of a key that are chained together.
CAPACITY = 500
MAX_DEPTH = 16
PART_ROWS = 2_000

_BLANKS = re.compile(rb"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+")


def normalised(text: str | None) -> bytes:
    return _BLANKS.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


def key_of(digest: bytes, bits: int = 64) -> int:
    """The leading bits of a digest as a signed long; fewer bits leave the rest zero."""
    head = int.from_bytes(digest[:8], "big") >> (64 - bits) << (64 - bits)
    return head - (1 << 64) if head >> 63 else head


def numbered(docs: DataFrame) -> DataFrame:
    """``row, doc_id, text``: a number for each row, the same whenever the same files are read."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def entries(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``row, doc_id, key, text_sha256`` of every row."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("text_sha256", pa.string())])

    def run(batches):
        for batch in hands(batches):
            digests = [hashlib.sha256(normalised(t)).digest() for t in batch.column("text").to_pylist()]
            yield record(schema, row=batch.column("row"), doc_id=batch.column("doc_id"), key=[key_of(d, bits) for d in digests], text_sha256=[d.hex() for d in digests])

    return mapped(numbered(docs), run, "row long, doc_id long, key long, text_sha256 string")


def texts_of(docs: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """``shared`` (``row, key, bucket, task``) with the doc_id and normalised text of each row, read once more and checked against the key."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("bucket", pa.int32()), ("task", pa.int32()), ("norm", pa.binary())])

    def run(batches):
        for batch in hands(batches):
            norms = [normalised(t) for t in batch.column("text").to_pylist()]
            if [key_of(hashlib.sha256(n).digest(), bits) for n in norms] != batch.column("key").to_pylist():
                raise RuntimeError("the documents came in another order than before: write them to a table first")
            yield record(schema, norm=norms, **{c: batch.column(c) for c in ("row", "doc_id", "key", "bucket", "task")})

    rows = numbered(docs).join(shared, "row")
    return mapped(rows, run, "row long, doc_id long, key long, bucket int, task int, norm binary")


class Directory:
    """Extendible hashing on key prefixes, fed with the number of keys under each prefix."""

    def __init__(self, keys_under: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH):
        self.depth, self.slots = 0, [0]
        self.local_depth, self.size = [0], [sum(keys_under.values())]
        counts = np.zeros((1 << max_depth) + 1, dtype=np.int64)
        for prefix, n in keys_under.items():
            counts[prefix + 1] = n
        self.below, self.max_depth = np.cumsum(counts), max_depth
        full = [0]
        while full:
            bucket = full.pop()
            if self.size[bucket] > capacity and self.local_depth[bucket] < max_depth:
                full += self.split(bucket)

    def split(self, bucket: int) -> tuple[int, int]:
        """Give the upper half of a bucket's key range to a new bucket."""
        if self.local_depth[bucket] == self.depth:
            self.slots = [b for b in self.slots for _ in range(2)]
            self.depth += 1
        span = 1 << (self.depth - self.local_depth[bucket])
        first, new = self.slots.index(bucket), len(self.size)
        middle = first + span // 2
        self.slots[middle:first + span] = [new] * (span // 2)
        self.local_depth[bucket] += 1
        self.local_depth.append(self.local_depth[bucket])
        upper = self.held(middle, span // 2)
        self.size[bucket] -= upper
        self.size.append(upper)
        return bucket, new

    def held(self, slot: int, n: int) -> int:
        shift = self.max_depth - self.depth
        return int(self.below[(slot + n) << shift] - self.below[slot << shift])


def prefix(key: str, bits: int):
    """The leading bits of a key as an int."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> Directory:
    counted = keys.groupBy(prefix("key", max_depth).alias("p")).count().collect()
    return Directory({r["p"]: r["count"] for r in counted}, capacity, max_depth)


def owned(index: Directory, tasks: int) -> list[tuple[int, int, int]]:
    """``slot, bucket, owner`` of every slot: an owner has buckets that lie side by side, as many as any other, or one less."""
    first: dict[int, int] = {}
    for slot, bucket in enumerate(index.slots):
        first.setdefault(bucket, slot)
    place = {bucket: i for i, bucket in enumerate(sorted(first, key=first.get))}
    tasks = min(tasks, len(place))
    return [(slot, bucket, place[bucket] * tasks // len(place)) for slot, bucket in enumerate(index.slots)]


def bucketed(keys: DataFrame, index: Directory, slots: DataFrame) -> DataFrame:
    """``keys`` with the bucket and the owner of each: those of the slot that its leading bits name.

    The directory has at most ``2 ** max_depth`` slots, so it is broadcast.
    """
    return keys.withColumn("slot", prefix("key", index.depth)).join(F.broadcast(slots), "slot").drop("slot")


def chained(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple], list[bool]]]:
    """For rows sorted by key: the row and doc_id of each row's link, and whether the row began it."""
    key, links = None, []
    for batch in hands(rows, "norm"):
        reps, first = [], []
        for k, row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "doc_id", "norm")), strict=True):
            if k != key:
                key, links = k, []
            rep = next((r for t, r in links if t == text), None)
            first.append(rep is None)
            if rep is None:
                links.append((text, rep := (row, doc_id)))
            reps.append(rep)
        yield batch, reps, first


_PART = "bucket int, key long, row long, doc_id long, rep_row long, norm binary"
_LINK = "rep_row long, keep_row long, keep_id long"
_PART_SCHEMA = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("rep_row", pa.int64()), ("norm", pa.binary())])
_LINK_SCHEMA = pa.schema([("rep_row", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64())])


def chain_parts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its part's link; the text goes on with the row that began the link."""
    for batch, reps, first in chained(rows):
        texts = batch.column("norm").to_pylist()
        yield record(_PART_SCHEMA, rep_row=[r for r, _ in reps], norm=[t if f else None for t, f in zip(texts, first, strict=True)],
                     **{c: batch.column(c) for c in ("bucket", "key", "row", "doc_id")})


def chain_owners(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every part's link with the link of the whole key that it belongs to."""
    for batch, reps, _ in chained(rows):
        yield record(_LINK_SCHEMA, rep_row=batch.column("row"), keep_row=[r for r, _ in reps], keep_id=[d for _, d in reps])


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, bits: int = 64, part_rows: int = PART_ROWS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row.

    ``bits`` shortens the keys; the tests use that to make them collide.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "hash-index")
    entries(docs, bits).write.parquet(f"{path}/entries")
    every = spark.read.parquet(f"{path}/entries")
    every.groupBy("key").agg(F.count("*").alias("n")).write.parquet(f"{path}/keys")
    keys = spark.read.schema("key long, n long").parquet(f"{path}/keys")
    index = directory(keys, capacity, max_depth)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.createDataFrame(owned(index, tasks), "slot int, bucket int, owner int").coalesce(1).write.parquet(f"{path}/directory")
    slots = spark.read.schema("slot int, bucket int, owner int").parquet(f"{path}/directory")
    several = bucketed(keys.filter("n > 1"), index, slots).select("key", "bucket", "owner", F.ceil(F.col("n") / part_rows).cast("int").alias("salts"))
    several = small(written(several, "several-keys"))
    # Owners take whole buckets.  Of a key of many rows only the first part is its owner's; the other parts are
    # chained by any, and send on one text a link.
    salt = F.pmod("row", F.col("salts"))
    helper = F.when(salt == 0, F.col("owner")).otherwise(F.pmod(F.xxhash64("key", salt), F.lit(tasks)).cast("int"))
    by_id = F.col("doc_id").asc_nulls_last()
    shared = every.select("row", "key").join(several, "key").select("row", "key", "bucket", helper.alias("task"))
    rows = texts_of(docs, small(written(shared, "shared")), bits)
    mapped(_owned_rows(rows, tasks, "task", by_id), chain_parts, _PART).write.option("compression", "zstd").parquet(f"{path}/parts")
    parts = spark.read.schema(_PART).parquet(f"{path}/parts")
    begun = bucketed(parts.filter("norm is not null").drop("bucket"), index, slots)
    mapped(_owned_rows(begun, tasks, "owner", by_id), chain_owners, _LINK).write.parquet(f"{path}/links")
    # A part's row begins at most as many links as it has rows, so no link has more than ``part_rows`` rows here.
    links = spark.read.schema(_LINK).parquet(f"{path}/links")
    members = written(parts.select("row", "rep_row").join(links, "rep_row").select("row", "keep_row", "keep_id"), "members")
    sizes = small(written(members.groupBy("keep_row").agg(F.count("*").alias("group_size")), "sizes"))
    placed = members.join(sizes, "keep_row").select(F.col("row").alias("of"), "keep_id", "group_size", F.lit(True).alias("grouped"))
    return every.join(placed, every["row"] == placed["of"], "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("grouped"), F.col("keep_id").eqNullSafe(F.col("doc_id"))).otherwise(F.lit(True)).alias("kept"),
        "text_sha256")


def _owned_rows(rows: DataFrame, tasks: int, task: str, by_id) -> DataFrame:
    """The rows in the tasks that are named, sorted by bucket and key."""
    dealt = rows.repartitionById(tasks, F.col(task))
    return dealt.sortWithinPartitions("bucket", "key", by_id, "row").select("bucket", "key", "row", "doc_id", "norm")
