"""Removal of byte strings that occur twice anywhere, by blockwise sorting of suffixes with a difference cover.

A string of ``length`` bytes (200) starts at two places i and j.  The cover's residues are such that for
some shift below its period v both i + shift and j + shift are sample places, whatever i and j are.  So:

1. *Cover ranks.*  The samples of every document are ranked by the string of length - v + 1 bytes that
   begins there; any order serves, as long as equal strings share a rank, and this is the order of their
   64-bit fingerprints.  Only ranks held by several samples matter further on.
2. *Blocks of suffixes.*  A suffix that could have a twin has a ranked sample within reach.  Suffixes are
   sorted one block at a time, a block being the suffixes of a range of ranks, so a task holds some ten
   thousands of them.  Within a rank the long middle of a suffix is a tie that the rank resolves; order is
   decided by the shift and the bytes to both sides.  What is sent for all v suffixes around a sample is its
   context, the v - 1 bytes before it to ``length`` bytes behind its start, and each different context once.
3. Neighbours that agree are compared byte by byte, the middle included.

Contexts that occur twice as a whole need no sorting, only one of each stands in for them.  Ranks whose
contexts are all alike send nothing.  A rank of very many different contexts (``SPLIT``) is grouped by
window over many tasks, with a map-side combine, in place of one task's sort; there equality is that of two
64-bit hashes.  Equal whole texts are told beforehand, and only the first of them takes part.

Texts travel in blocks of about 4 MB, compressed, since what comes back to a block is bounded by it; the
text of one document is never cut, and hashed a segment at a time.  Null texts count as empty; texts below
``length`` lose nothing; rows that repeat a doc_id, or have none, are documents of their own; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, small, written
from .common import mapped, record

LENGTH = 200
# Difference covers, each residue of a period being a difference of two of them in one way.
COVERS = {
    3: [0, 1], 7: [0, 1, 3], 13: [0, 1, 3, 9], 21: [0, 1, 4, 14, 16], 31: [0, 1, 3, 8, 12, 18],
    57: [0, 1, 3, 13, 32, 36, 43, 52], 73: [0, 1, 3, 7, 15, 31, 36, 54, 63], 91: [0, 1, 3, 9, 27, 49, 56, 61, 77, 81],
}
# Bytes of text in a block, and hashed at once; samples to a bucket of the ranking; contexts sorted at once.
BLOCK = 4 << 20
SEGMENT = 1 << 20
BUCKET = 2_000_000
# Of the compression of blocks, which are kept and sent.
LEVEL = 7
# Full blocks to a bucket, at most, on average.
TOGETHER = 16
SORTED = 20_000
# Different contexts of one rank that a task sorts; ranks of more are grouped over many tasks.
SPLIT = 50_000

_BASE = 0x9E3779B97F4A7C15
# Bits of the fingerprints by which ranks are first told to be shared.
_BITS = 48
_SHORT = np.uint64((1 << _BITS) - 1)
_BLOCKS = "block long, doc_ids array<long>, sizes array<long>, hashes array<binary>, body binary"


def period(length: int) -> int:
    """The greatest period that leaves samples strings of more than half the length."""
    fitting = [v for v in COVERS if v <= 0.46 * length]
    if not fitting:
        raise ValueError("strings must be of 7 bytes or more")
    return max(fitting)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(data: np.ndarray, starts: np.ndarray, sizes) -> np.ndarray:
    """Fingerprint of each string of the data, whose starts ascend; a segment's sums are held at a time.

    ``sizes`` is a number or an array, small against ``SEGMENT``.
    """
    out = np.empty(len(starts), np.uint64)
    sizes = np.broadcast_to(np.asarray(sizes, np.int64), starts.shape)
    longest = int(sizes.max(initial=0))
    up, down = _powers(SEGMENT + longest + 2)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        end = int(np.searchsorted(starts, base + SEGMENT))
        piece = data[base:int(starts[end - 1]) + longest]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece + np.uint64(1)) * up[:len(piece)], out=sums[1:])
        here = starts[at:end] - base
        out[at:end] = (sums[here + sizes[at:end]] - sums[here]) * down[here]
        at = end
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def samples(sizes: np.ndarray, skipped: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample places of documents laid end to end, and the bytes before and from each within its document."""
    v = period(length)
    cover = np.array(COVERS[v])
    reach = length - v + 1
    ends = np.cumsum(sizes)
    found = [np.zeros(0, np.int64)]
    docs = np.flatnonzero((sizes >= length) & ~skipped)
    for d in docs:
        begin, room = int(ends[d] - sizes[d]), int(sizes[d]) - reach + 1
        places = (np.arange(0, room, v)[:, None] + cover).reshape(-1)
        found.append(begin + places[places < room])
    place = np.concatenate(found)
    of = np.repeat(docs, [len(x) for x in found[1:]]) if len(docs) else np.zeros(0, np.int64)
    return place, place - (ends[of] - sizes[of]), ends[of] - place


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Whole texts in compressed blocks, written once; long blocks of few rows, so that a batch holds little else."""
    import hashlib

    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
                        ("hashes", pa.list_(pa.binary())), ("body", pa.binary())])

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=LEVEL)
        held: list[tuple] = []
        made, size = TaskContext.get().partitionId() << 32, 0

        def block():
            ids, texts = zip(*held, strict=True)
            return record(schema, block=[made], doc_ids=[list(ids)], sizes=[[len(t) for t in texts]],
                          hashes=[[hashlib.sha256(t).digest() for t in texts]], body=[packer.compress(b"".join(texts))])

        for batch in batches:
            for doc_id, bytes_ in zip(batch.column("doc_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if held and size + len(bytes_) > BLOCK:
                    yield block()
                    made, held, size = made + 1, [], 0
                held.append((doc_id, bytes_))
                size += len(bytes_)
        if held:
            yield block()

    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("bytes"))
    size = named.agg(F.sum(F.length("bytes"))).first()[0] or 0
    return by_block(mapped(named, run, _BLOCKS), math.ceil(size / BLOCK / TOGETHER))


def by_block(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks dealt once into so many buckets, or as many as shuffles have, by their number: no later join sends their texts again.

    Buckets are known to the catalog only, so the files under the shared folder have an entry there while they are opened.
    """
    spark = blocks.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    path = fresh_path(spark, "blocks")
    name = "tremor_" + path.rsplit("-", 1)[-1]
    blocks.repartition(buckets, "block").write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def _opened(body: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)


def copies(blocks: DataFrame, length: int) -> DataFrame:
    """``block, at, first``: rows whose whole text, of ``length`` bytes or more, occurs again, and the first of each."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("sizes", "hashes")).alias("at", "x")).filter(F.col("x.sizes") >= length)
    rows = rows.select("block", "at", F.col("x.hashes").alias("hash"))
    several = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block", "at")).alias("lead")).filter("n > 1")
    several = small(written(several.select(F.col("hash").alias("of"), "lead"), "copied"))
    return written(rows.join(several, rows["hash"] == several["of"]).select(
        "block", "at", (F.struct("block", "at") == F.col("lead")).alias("first")), "copies")


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of all, compressed."""
    import zstandard

    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _values(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").reshape(-1), dtype=np.uint64)


def _among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among ascending values; the work goes with x."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def ranked(blocks: DataFrame, length: int) -> DataFrame:
    """``block, ranks``: the ranks of a block's samples that are held by several samples of all documents."""
    reach = length - period(length) + 1
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, math.ceil(size * len(COVERS[period(length)]) / period(length) / BUCKET))
    sent = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("ranks", pa.binary())])

    def places(batches):
        for batch in batches:
            for block, sizes, body in zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body")), strict=True):
                place, _, _ = samples(np.array(sizes), np.zeros(len(sizes), bool), length)
                if not len(place):
                    continue
                # As short as they are, two different strings rarely agree, and that costs work only.
                found, n = np.unique(fingerprints(_opened(body), place, reach) & _SHORT, return_counts=True)
                found = np.repeat(found, np.minimum(n, 2))
                which = (found.astype(np.float64) / 2.0 ** _BITS * buckets).astype(np.int64)
                edge = np.flatnonzero(np.diff(which, prepend=-1))
                yield record(sent, bucket=which[edge].tolist(), block=[block] * len(edge), ranks=[
                    _planes(found[a:b]) for a, b in zip(edge, np.append(edge[1:], len(found)), strict=True)])

    back = pa.schema([("block", pa.int64()), ("ranks", pa.binary())])

    def sorted_bucket(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        of = [_values(packed) for _, packed in held]
        together = np.sort(np.concatenate(of))
        again = np.unique(together[1:][np.diff(together) == 0])
        ranks = [np.unique(x[_among(again, x)]) for x in of]
        return record(back, block=[b for (b, _), r in zip(held, ranks, strict=True) if len(r)], ranks=[_planes(r) for r in ranks if len(r)])

    def owners(batches):
        held, bucket = [], None
        for batch in batches:
            for b, block, packed in zip(*(batch.column(c).to_pylist() for c in sent.names), strict=True):
                if held and b != bucket:
                    yield sorted_bucket(held)
                    held = []
                bucket = b
                held.append((block, packed))
        if held:
            yield sorted_bucket(held)

    dealt = mapped(blocks.select("block", "sizes", "body"), places, "bucket long, block long, ranks binary").repartition("bucket").sortWithinPartitions("bucket")
    return written(mapped(dealt, owners, "block long, ranks binary"), "ranks")


def _with(blocks: DataFrame, how: str, **replies: DataFrame) -> DataFrame:
    """Blocks beside what is told of them: each reply's rows of a block, without its number, as a list.

    A list is bounded by what a block holds.
    """
    out = blocks
    for name, rows in replies.items():
        rest = [c for c in rows.columns if c != "block"]
        listed = rows.groupBy("block").agg(F.collect_list(F.struct(*rest) if len(rest) > 1 else F.col(*rest)).alias(name))
        out = out.join(listed, "block", how if name == next(iter(replies)) else "left")
    return out


def _numbers(column: pa.Array, i: int, names: tuple[str, ...]) -> list[np.ndarray]:
    """The fields of one row's list of structs, as arrays."""
    held = column[i].values
    if held is None:
        return [np.zeros(0, np.int64) for _ in names]
    return [held.field(held.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _contexts(data: np.ndarray, place: np.ndarray, before: np.ndarray, behind: np.ndarray, length: int):
    """Rank and fingerprint of the contexts of samples, and their bytes before and from the sample."""
    v = period(length)
    left, right = np.minimum(before, v - 1), np.minimum(behind, length)
    # Starts of contexts at a document's edge may fall back behind their predecessor's.
    order = np.argsort(place - left, kind="stable")
    marks = np.empty(len(place), np.uint64)
    marks[order] = fingerprints(data, (place - left)[order], (left + right)[order])
    marks = mix(marks + left.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return fingerprints(data, place, length - v + 1), marks, left, right


def seen_contexts(blocks: DataFrame, ranks: DataFrame, copied: DataFrame, length: int) -> DataFrame:
    """``block, rank, context, n``: the different contexts of a block's samples of shared rank, n at most 2."""
    schema = pa.schema([("block", pa.int64()), ("rank", pa.int64()), ("context", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for i, (block, sizes, body, mine, gone) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "sizes", "body", "ranks", "gone")), strict=True)):
                skipped = np.zeros(len(sizes), bool)
                skipped[gone or []] = True
                shared = np.unique(np.concatenate([_values(x) for x in mine]))
                place, before, behind = samples(np.array(sizes), skipped, length)
                data = _opened(body)
                rank = fingerprints(data, place, length - period(length) + 1) & _SHORT
                at = np.minimum(np.searchsorted(shared, rank), len(shared) - 1)
                keep = shared[at] == rank
                if not keep.any():
                    continue
                rank, mark, _, _ = _contexts(data, place[keep], before[keep], behind[keep], length)
                both, n = np.unique(np.stack([rank, mark], axis=1).view(np.int64), axis=0, return_counts=True)
                yield record(schema, block=pa.array(np.full(len(both), block)), rank=pa.array(both[:, 0]), context=pa.array(both[:, 1]),
                             n=pa.array(np.minimum(n, 2).astype(np.int32)))

    gone = copied.filter("not first").select("block", "at")
    beside = _with(blocks.select("block", "sizes", "body"), "inner", ranks=ranks, gone=gone)
    return written(mapped(beside, run, "block long, rank long, context long, n int"), "contexts")


def sent_contexts(blocks: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``rank, context, left, bytes`` of the wanted contexts, each read from the block that is named for it."""
    schema = pa.schema([("rank", pa.int64()), ("context", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])

    def run(batches):
        for batch in batches:
            asked = batch.column("asked")
            for i, (sizes, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("sizes", "body")), strict=True)):
                ranks, marks = _numbers(asked, i, ("rank", "context"))
                data = _opened(body)
                place, before, behind = samples(np.array(sizes), np.zeros(len(sizes), bool), length)
                near = np.isin(fingerprints(data, place, length - period(length) + 1).view(np.int64), ranks)
                place, before, behind = place[near], before[near], behind[near]
                rank, mark, left, right = _contexts(data, place, before, behind, length)
                own = _keys(rank.view(np.int64), mark.view(np.int64))
                found, first = np.unique(own, return_index=True)
                # In text order, where neighbours overlap and compress well.
                first = np.sort(first[np.isin(found, _keys(ranks, marks))])
                view = data.tobytes()
                yield record(schema, rank=pa.array(rank[first].view(np.int64)), context=pa.array(mark[first].view(np.int64)), left=pa.array(left[first].astype(np.int32)),
                             bytes=[view[p - a:p + b] for p, a, b in zip(place[first].tolist(), left[first].tolist(), right[first].tolist(), strict=True)])

    beside = _with(blocks.select("block", "sizes", "body"), "inner", asked=wanted.select("block", "rank", "context"))
    return mapped(beside, run, "rank long, context long, left int, bytes binary")


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of numbers as values that compare as a whole."""
    return np.ascontiguousarray(np.stack([a, b], axis=1)).view("V16").reshape(-1)


def _bits(shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of marked shifts as two longs, 64 shifts to each."""
    padded = np.zeros((len(shifts), 128), bool)
    padded[:, :shifts.shape[1]] = shifts
    packed = np.packbits(padded, axis=1, bitorder="little").view("<i8")
    return packed[:, 0], packed[:, 1]


def twins(left: np.ndarray, context: list[bytes], length: int) -> np.ndarray:
    """For each context and shift, whether the suffix that begins so far before the sample has a twin among the others.

    The contexts are all those of some ranks.
    """
    v = period(length)
    full = np.zeros((len(context), v - 1 + length), np.uint8)
    right = np.array([len(c) for c in context]) - left
    for row, (a, c) in enumerate(zip(left.tolist(), context, strict=True)):
        full[row, v - 1 - a:v - 1 - a + len(c)] = np.frombuffer(c, np.uint8)
    up, down = _powers(full.shape[1] + 1)
    sums = np.zeros((len(full), full.shape[1] + 1), np.uint64)
    np.cumsum((full + np.uint64(1)) * up[:full.shape[1]], axis=1, out=sums[:, 1:])
    out = np.zeros((len(full), v), bool)
    for shift in range(v):
        begin = v - 1 - shift
        there = np.flatnonzero((left >= shift) & (right >= length - shift))
        if len(there) < 2:
            continue
        h = (sums[there, begin + length] - sums[there, begin]) * down[begin]
        order = np.argsort(h)
        h, rows = h[order], there[order]
        tie = np.flatnonzero(h[1:] == h[:-1])
        if not len(tie):
            continue
        window = slice(begin, begin + length)
        same = (full[rows[tie], window] == full[rows[tie + 1], window]).all(axis=1)
        if same.all():
            out[rows[tie], shift] = out[rows[tie + 1], shift] = True
        else:  # strings that differ share a fingerprint: sort by the bytes themselves
            _, which, n = np.unique(np.ascontiguousarray(full[there, window]), axis=0, return_inverse=True, return_counts=True)
            out[there[n[which.reshape(-1)] > 1], shift] = True
    return out


def sorted_blocks(contexts: DataFrame, length: int) -> DataFrame:
    """``rank, context, low, high``: marked shifts of contexts, each block of ranks sorted in one task."""
    schema = pa.schema([("rank", pa.int64()), ("context", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def marked(held: list[tuple]) -> pa.RecordBatch:
        rank, mark, left, context = zip(*held, strict=True)
        shifts = twins(np.array(left), list(context), length)
        some = np.flatnonzero(shifts.any(axis=1))
        low, high = _bits(shifts[some])
        return record(schema, rank=[rank[i] for i in some], context=[mark[i] for i in some], low=pa.array(low), high=pa.array(high))

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("rank", "context", "left", "bytes")), strict=True):
                if len(held) >= SORTED and row[0] != held[-1][0]:
                    yield marked(held)
                    held = []
                held.append(row)
        if held:
            yield marked(held)

    return mapped(contexts.repartition("rank").sortWithinPartitions("rank"), run, "rank long, context long, low long, high long")


def grouped_windows(contexts: DataFrame, length: int) -> DataFrame:
    """The same for ranks of very many contexts: their windows are grouped by shift and hash, over all tasks."""
    v = period(length)
    shifts = F.sequence(F.greatest(F.lit(0), length - (F.length("bytes") - F.col("left"))), F.least(F.lit(v - 1), F.col("left")))
    whole = contexts.filter((F.length("bytes") >= length) & (length - (F.length("bytes") - F.col("left")) <= F.least(F.lit(v - 1), F.col("left"))))
    each = whole.select("rank", "context", "left", "bytes", F.explode(shifts).alias("shift"))
    window = F.substring(F.col("bytes"), F.col("left") - F.col("shift") + 1, F.lit(length))
    each = each.select("rank", "context", "shift", F.xxhash64(window).alias("h"), F.xxhash64(F.lit(1), window).alias("k"))
    several = each.groupBy("shift", "h", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    bit = F.expr("shiftleft(1L, shift % 64)")
    return each.join(several, ["shift", "h", "k"]).groupBy("rank", "context").agg(
        F.coalesce(F.bit_or(F.when(F.col("shift") < 64, bit)), F.lit(0).cast("long")).alias("low"),
        F.coalesce(F.bit_or(F.when(F.col("shift") >= 64, bit)), F.lit(0).cast("long")).alias("high"))


def marked_contexts(blocks: DataFrame, seen: DataFrame, length: int, split: int = SPLIT) -> DataFrame:
    """``block, rank, context, low, high``: for each block's contexts, the shifts whose suffixes have a twin."""
    once = written(seen.groupBy("rank", "context").agg(F.sum("n").alias("n"), F.min("block").alias("block")), "once")
    mixed = small(written(once.groupBy(F.col("rank").alias("of")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "mixed"))
    wanted = once.join(mixed, once["rank"] == mixed["of"])
    sent = written(sent_contexts(blocks, wanted, length), "sent")
    hot = mixed.filter(F.col("k") > split).select("of")
    if hot.isEmpty():
        found = sorted_blocks(sent, length)
    else:
        found = sorted_blocks(sent.join(hot, sent["rank"] == hot["of"], "left_anti"), length).unionByName(
            grouped_windows(sent.join(hot, sent["rank"] == hot["of"], "left_semi"), length))
    whole = once.filter("n > 1").select("rank", "context", F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    alone = found.join(once.filter("n = 1").select("rank", "context"), ["rank", "context"])
    marks = written(whole.unionByName(alone.select(whole.columns)), "marks")
    return seen.select("block", "rank", "context").join(marks, ["rank", "context"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", split: int = SPLIT) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: the maximal runs of bytes that lie in a string occurring twice, and the bytes without them."""
    v = period(length)
    blocks = text_blocks(docs, key, text)
    copied = copies(blocks, length)
    seen = seen_contexts(blocks, ranked(blocks, length), copied, length)
    marks = marked_contexts(blocks, seen, length, split)
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def starts(data, sizes, copied_rows, ranks, marks, low, high) -> np.ndarray:
        """Where strings start that have a twin."""
        place, before, behind = samples(sizes, copied_rows, length)
        near = np.isin(fingerprints(data, place, length - v + 1).view(np.int64), ranks)
        place, before, behind = place[near], before[near], behind[near]
        rank, mark, _, _ = _contexts(data, place, before, behind, length)
        known, own = _keys(ranks, marks), _keys(rank.view(np.int64), mark.view(np.int64))
        order = np.argsort(known)
        at = np.minimum(np.searchsorted(known[order], own), len(known) - 1)
        hit = known[order][at] == own
        place, before, behind, at = place[hit], before[hit], behind[hit], order[at[hit]]
        out = np.zeros(len(data), bool)
        for shift in range(v):
            half, bit = (low, shift) if shift < 64 else (high, shift - 64)
            there = ((half[at] >> bit) & 1).astype(bool) & (before >= shift) & (behind >= length - shift)
            out[place[there] - shift] = True
        return np.flatnonzero(out)

    def run(batches):
        for batch in batches:
            replies = batch.column("marks")
            for i, (ids, sizes, body, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "sizes", "body", "whole")), strict=True)):
                data, sizes = _opened(body), np.array(sizes)
                ends = np.cumsum(sizes)
                all_gone = np.zeros(len(sizes), bool)
                all_gone[whole or []] = True
                cover = np.zeros(len(data) + 1, np.int32)
                ranks, marks, low, high = _numbers(replies, i, ("rank", "context", "low", "high"))
                if len(ranks):
                    begin = starts(data, sizes, all_gone, ranks, marks, low, high)
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                for d in np.flatnonzero(all_gone):
                    gone[ends[d] - sizes[d]:ends[d]] = True
                spans, kept = [], []
                for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    mine = gone[a:b]
                    edge = np.flatnonzero(np.diff(mine.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
                    spans.append([{"start": s, "length": e - s} for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                    kept.append(data[a:b][~mine].tobytes() if len(edge) else data[a:b].tobytes())
                yield record(schema, doc_id=ids, n_bytes=sizes.tolist(), spans=pa.array(spans, pa.list_(span)), kept=kept)

    beside = _with(blocks.select("block", "doc_ids", "sizes", "body"), "left", marks=marks, whole=copied.select("block", "at"))
    return mapped(beside, run, "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
