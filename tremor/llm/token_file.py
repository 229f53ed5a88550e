"""Token files: frequency-ranked ids in a byte-aligned code with separate control bytes.

An id is replaced by its rank by falling corpus frequency, so the commonest 256 ids take one
byte.  A document is two byte streams: two control bits an id (its bytes, less one; four ids a
control byte, first id in the lowest bits, unused slots zero) and the ranks' low bytes.  A file
is a Parquet shard with one row a document (``shard, doc_id, local_start, n_tokens, control,
data``); rows ascend by doc_id within a shard and from shard to shard, and ``ranks`` beside the
shards holds the id of every rank.  Parquet gives atomic commits on any store that Spark
reaches, and readers may take the id counts without the streams.

Null texts count as empty, a null doc_id sorts first, rows that repeat a doc_id stand side by
side, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .common import hands, mapped, record
from .tokens import AMPLE, Memory, encoder

_IDS = "doc_id long, ids binary"
_SHARD = "shard int, doc_id long, local_start long, n_tokens long, control binary, data binary"
_READ = "shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long"

# Bytes of the four ids under each control byte.
LENGTHS = np.array([[1 + (c >> (2 * i) & 3) for i in range(4)] for c in range(256)], dtype=np.uint8)
_PLACES = np.arange(4, dtype=np.uint8)


def _binary(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _used(counts: np.ndarray, control_ends: np.ndarray) -> np.ndarray:
    """Which slots of the control bytes hold an id: all but up to three at a document's end."""
    used = np.ones(4 * (int(control_ends[-1]) if len(counts) else 0), dtype=bool)
    for back in range(1, 4):
        used[(4 * control_ends - back)[-counts % 4 >= back]] = False
    return used


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of documents of ``counts`` ids, with the end of each document in either."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8)
    for bound in (0xFFFF, 0xFFFFFF):
        code += ranks > bound
    ends, control_ends = np.cumsum(counts), np.cumsum((counts + 3) // 4)
    slots = np.zeros(4 * (control_ends[-1] if len(counts) else 0), dtype=np.uint8)
    slots[_used(counts, control_ends)] = code
    control = slots[0::4] | slots[1::4] << 2 | slots[2::4] << 4 | slots[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[_PLACES <= code[:, None]]
    total = np.concatenate([[0], np.cumsum(code, dtype=np.int64)])
    return control, control_ends, data, total[ends] + ends


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents of ``counts`` ids whose streams stand end to end."""
    lengths = LENGTHS[control].reshape(-1)[_used(counts, np.cumsum((counts + 3) // 4))]
    value = np.zeros((len(lengths), 4), dtype=np.uint8)
    value[_PLACES < lengths[:, None]] = data
    return value.view("<u4").reshape(-1)


def _span(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and the length of each value."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, np.diff(offsets).astype(np.int64)


def tokenized(docs: DataFrame, path: str, end_id: int, memory: Memory = AMPLE) -> DataFrame:
    """``doc_id, ids``: ids of the whole texts with the end id, as little-endian unsigned integers of 16 or 32 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    width = id_width(path)

    def run(batches):
        encode, end = encoder(path, memory).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in hands(batches):
            parts = [encode(t) + end for t in batch.column("text").to_pylist()]
            counts = np.array([len(p) // 4 for p in parts], dtype=np.int64)
            ids = np.frombuffer(b"".join(parts), dtype="<u4").astype(width)
            yield record(schema, doc_id=batch.column("doc_id"), ids=_binary(ids, np.cumsum(counts) * ids.itemsize))

    return mapped(docs.select("doc_id", "text"), run, _IDS, tokens=True)


def id_width(path: str) -> str:
    return "<u2" if encoder(path).library.get_vocab_size() <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, width: str) -> DataFrame:
    """``id, n`` over all documents; a task sends each id it met once."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            data, _ = _span(batch.column("ids"))
            here = np.bincount(np.frombuffer(data.tobytes(), dtype=width))
            if len(here) < len(counts):
                here = np.pad(here, (0, len(counts) - len(here)))
            counts = here + np.pad(counts, (0, len(here) - len(counts)))
        found = np.flatnonzero(counts)
        yield record(schema, id=pa.array(found), n=pa.array(counts[found]))

    return mapped(tokens.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class TokenFile:
    """Shards under ``path``, the id of every rank, and the tokenizer's id count."""

    path: str
    id_of: np.ndarray


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> TokenFile:
    """Encode every whole text and write the shards in ascending doc_id order.

    The tokens are written once, in the shared folder, since both the ranks and the shards
    need them.  What reaches the driver is one count for each id of the vocabulary.
    """
    spark, width = docs.sparkSession, id_width(tokenizer)
    stored = fresh_path(spark, "tokens")
    tokenized(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(stored)
    tokens = spark.read.schema(_IDS).parquet(stored)
    counted = frequencies(tokens, width).orderBy(F.desc("n"), "id").select("id").collect()
    id_of = np.array([r[0] for r in counted], dtype="<u4")
    rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, dtype="<u4")
    rank_of[id_of] = np.arange(len(id_of), dtype="<u4")
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()),
                        ("control", pa.binary()), ("data", pa.binary())])

    def coded(batches):
        at, shard = 0, TaskContext.get().partitionId()
        for batch in hands(batches, "ids"):
            raw, sizes = _span(batch.column("ids"))
            ids = np.frombuffer(raw.tobytes(), dtype=width)
            counts = sizes // ids.itemsize
            control, control_ends, data, data_ends = encode_ranks(rank_of[ids], counts)
            ends = at + np.cumsum(counts)
            yield record(schema, shard=pa.array(np.full(len(counts), shard, dtype=np.int32)), doc_id=batch.column("doc_id"), local_start=pa.array(ends - counts),
                         n_tokens=pa.array(counts), control=_binary(control, control_ends), data=_binary(data, data_ends))
            at = int(ends[-1])

    # Put in order before they are coded: finding the ranges reads the rows once more, which should cost no coding.
    # Length and hash spread the rows of one doc_id, or of none, over tasks.
    order = ["doc_id", F.length("ids"), F.xxhash64("ids")]
    ordered = tokens.repartitionByRange(*order).sortWithinPartitions(*order)
    mapped(ordered, coded, _SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(id_of)], "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    return TokenFile(path, id_of)


def open_file(spark: SparkSession, path: str) -> TokenFile:
    rows = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    return TokenFile(path, np.array([r["id"] for r in rows], dtype="<u4"))


def _decoded(batch: pa.RecordBatch, id_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = batch.column("n_tokens").to_numpy()
    ranks = decode_ranks(_span(batch.column("control"))[0], _span(batch.column("data"))[0], counts)
    return (id_of[ranks] if len(ranks) else ranks.astype("<u4")), np.cumsum(counts)


def starts(spark: SparkSession, file: TokenFile) -> DataFrame:
    """``shard, base``: the ids in all earlier shards.  One row a shard."""
    sizes = spark.read.schema(_SHARD).parquet(f"{file.path}/shards").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_ids(spark: SparkSession, file: TokenFile) -> DataFrame:
    """``doc_id, ids``: the token ids of every document, decoded from the shards."""
    id_of = file.id_of

    def run(batches):
        for batch in hands(batches, "data"):
            ids, ends = _decoded(batch, id_of)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])

    scan = spark.read.schema(_SHARD).parquet(f"{file.path}/shards").select("doc_id", "n_tokens", "control", "data")
    return mapped(scan, run, "doc_id long, ids array<long>")


def digests(spark: SparkSession, file: TokenFile) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the shards."""
    id_of = file.id_of
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in hands(batches, "data"):
            ids, ends = _decoded(batch, id_of)
            raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            sums, at = [], 0
            for end in (ends * 4).tolist():
                sums.append(zlib.crc32(raw[at:end]))
                at = end
            yield record(schema, ids_crc32=pa.array(sums, pa.int64()), **{c: batch.column(c) for c in ("shard", "doc_id", "local_start", "n_tokens")})

    read = mapped(spark.read.schema(_SHARD).parquet(f"{file.path}/shards"), run, _READ)
    return read.join(starts(spark, file), "shard").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
