"""Similarity join of word shingle sets: rare-first prefixes with length, positional and suffix filters.

Two sets with a Jaccard similarity of 80 in 100 must share one of their ``n - ceil(0.8 n) + 1``
first shingles in any common order.  The order is rare first: by how often the shingle's hash
bucket (of 2 ** BUCKET_BITS) occurs in all documents, on a scale of sixteenths of a power of
two, then by hash, so what many documents share falls out of the prefixes.

1. One pass writes every document's set size and set key, and the bucket counts.  Documents of
   one set are one class; its least doc_id stands for it.
2. A second pass sends the prefix of one document a class and task, under the class's set key.  A shingle whose bucket is
   far above the mean is dealt to several tasks.  Shingles that only one document has go.
3. Candidates are found in rounds.  In up to STAR_ROUNDS of them each prefix shingle pairs one
   set of its largest component so far with the sets outside of it, so a group of k near copies
   costs some k pairs.  The last round pairs all that is still in different components; pairs
   within a component can't change it.  The filters apply to each, and each pair is verified once.

So the links found span the same components as all links would.  Verification compares whole
sets of 64-bit hashes.  ``components`` then gives the least doc_id in reach.

Null texts and texts without words have an empty set and link with nothing.  A null doc_id
links with nothing, and its component is null.  Rows that repeat a doc_id are one node with all
their links.  An empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, written
from .common import CHUNKS, added_up, chunked, hands, mapped, record
from .components import components
from .shingles import shingle_sets

BUCKET_BITS = 20
# A shingle whose bucket exceeds both this and HOT_FACTOR times the mean is dealt to several tasks.
HOT_ROWS = 20_000
HOT_FACTOR = 8
# Rounds in which a list's sets meet one set of its largest component, before all the rest meet.
STAR_ROUNDS = 2
# Cells of the suffix filter.
CELLS = 64

_FACTS = "doc_id long, n long, key1 long, key2 long, chunk int, counts binary"
_FACT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
_POSTING = "gram long, key1 long, key2 long, n int, pos int, salt int, salts int"
_POSTING_SCHEMA = pa.schema([("gram", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("salt", pa.int32()), ("salts", pa.int32())])


def prefix_length(n):
    """Shingles of which two similar sets share one: ``n - ceil(0.8 n) + 1``."""
    return n - (4 * n + 4) // 5 + 1


def set_key(grams: np.ndarray) -> tuple[int, int]:
    digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def facts(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (set size and key), and each task's bucket counts in chunks."""

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
        shift = np.uint64(64 - BUCKET_BITS)
        for batch in hands(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words)
            found = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            np.add.at(counts, found >> shift, np.uint32(1))
            keys = [set_key(s) for s in sets]
            nothing = [None] * len(sets)
            yield record(_FACT_SCHEMA, doc_id=batch.column("doc_id"), n=[len(s) for s in sets], key1=[k[0] for k in keys],
                         key2=[k[1] for k in keys], chunk=nothing, counts=nothing)
        if counts.any():
            nothing = [None] * CHUNKS
            yield record(_FACT_SCHEMA, doc_id=nothing, n=nothing, key1=nothing, key2=nothing, **chunked(counts))

    return mapped(docs.select("doc_id", "text"), run, _FACTS)


def postings(docs: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """The prefix shingles of one document for each set a task meets, rarest first."""
    commonness = np.round(16 * np.log2(1.0 + counts)).astype(np.uint16)
    hot = max(HOT_ROWS, int(HOT_FACTOR * counts.mean()))
    salts_of = {int(b): int(-(-int(counts[b]) // hot)) for b in np.flatnonzero(counts > hot)}
    hot_buckets = np.array(sorted(salts_of), dtype=np.uint64)
    hot_salts = np.array([salts_of[int(b)] for b in hot_buckets], dtype=np.int32)
    shift = np.uint64(64 - BUCKET_BITS)

    def run(batches):
        seen = set()
        for batch in hands(batches):
            grams, keys, sizes, places = [], [], [], []
            for node, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), words), strict=True):
                if node is None or not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                k = prefix_length(len(s))
                order = np.argsort(commonness[(s >> shift).astype(np.int64)], kind="stable")[:k]
                grams.append(s[order])
                keys.append(key)
                sizes.append(len(s))
                places.append(k)
            if not grams:
                continue
            gram, k = np.concatenate(grams), np.array(places)
            key1, key2 = (np.repeat(np.array(c, dtype=np.int64), k) for c in zip(*keys, strict=True))
            pos = (np.arange(len(gram)) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)
            salts = np.ones(len(gram), dtype=np.int32)
            if len(hot_buckets):
                bucket = gram >> shift
                at = np.minimum(np.searchsorted(hot_buckets, bucket), len(hot_buckets) - 1)
                salts = np.where(hot_buckets[at] == bucket, hot_salts[at], salts)
            yield record(_POSTING_SCHEMA, gram=pa.array(gram.view(np.int64)), key1=pa.array(key1), key2=pa.array(key2), n=pa.array(np.repeat(np.array(sizes, dtype=np.int32), k)),
                         pos=pa.array(pos), salt=pa.array((key1 % salts).astype(np.int32)), salts=pa.array(salts))

    return mapped(docs.select("doc_id", "text"), run, _POSTING)


_LIST = "gram long, key1 long, key2 long, n int, pos int"
_LIST_SCHEMA = pa.schema([("gram", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])


def shared_only(rows):
    """Of postings sorted by shingle, those whose neighbour has the same, and all of salted shingles."""
    held = None
    for batch in rows:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in (*_LIST_SCHEMA.names, "salts")]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        # The last row waits: the next batch may go on with its shingle.
        keep = _kept(columns)
        held = [c[-1:] for c in columns]
        told = keep[:-1]
        yield _listed([c[:-1][told] for c in columns])
        if keep[-1]:
            held[-1] = np.array([2], dtype=np.int32)  # it has a neighbour already
    if held is not None and held[-1][0] > 1:
        yield _listed(held)


def _kept(columns: list[np.ndarray]) -> np.ndarray:
    gram, salts = columns[0], columns[-1]
    same = gram[1:] == gram[:-1]
    keep = salts > 1
    keep[1:] |= same
    keep[:-1] |= same
    return keep


def _listed(columns: list[np.ndarray]) -> pa.RecordBatch:
    return record(_LIST_SCHEMA, **{c: pa.array(v) for c, v in zip(_LIST_SCHEMA.names, columns, strict=False)})


def _possible(a: str, b: str):
    """Length and positional filter for two rows of a list: the sizes allow the similarity, and so does what follows the shared shingle."""
    na, nb, ia, ib = (F.col(f"{x}.{c}").cast("long") for c in ("n", "pos") for x in (a, b))
    least = 4 * (na + nb)  # nine times the intersection that is needed
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (9 * (1 + F.least(na - ia - 1, nb - ib - 1)) >= least)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def parted(lists: DataFrame, placed: DataFrame) -> DataFrame:
    """The lists that several components still share, with each row's component ``c`` and size band."""
    known = lists.select("gram", "node", "n", "pos", "shared").join(placed, "node", "left").select(
        "gram", "node", "n", "pos", "shared", F.coalesce("component", "node").alias("c"), F.floor(F.log(F.col("n")) / F.log(F.lit(1.25))).cast("int").alias("band"))
    several = known.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("gram")
    return written(known.join(several, "gram"), "lists")


def star_round(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs of one set of each list's largest component with the list's sets outside of it.

    On the first turn that is the set of the most shared shingles: among near copies the one with
    the fewest edits of its own, to which most are similar.  On later turns it is the first by a
    hash of its id and the turn.  So the lists of a group agree on few, and every turn on others.
    Lists are led by size bands; a set meets the leads of its own band and the next.
    """
    first = F.xxhash64("node", F.lit(turn))
    first = F.struct((F.lit(0) if turn else -F.col("shared")).alias("s"), first.alias("h"))
    parts = lists.groupBy("gram", "band", "c").agg(F.count("*").alias("size"), F.min(F.struct(first.alias("h"), "node", "n", "pos")).alias("lead"))
    leads = parts.groupBy("gram", "band").agg(F.max_by(F.struct("lead", "c"), F.struct("size", F.struct(-F.col("lead.h.s"), -F.col("lead.h.h")))).alias("m")).select(
        "gram", "band", F.col("m.c").alias("c"), *(F.col(f"m.lead.{k}").alias(k) for k in ("node", "n", "pos")))
    meets = lists.withColumn("band", F.explode(F.array("band", F.col("band") + 1)))
    joined = meets.alias("x").join(leads.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band"))
                                   & (F.col("x.c") != F.col("y.c")) & _possible("x", "y"))
    return _ordered(joined.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")))


def last_round(lists: DataFrame) -> DataFrame:
    """All pairs of a list that lie in different components: those outside its largest one with all others."""
    mains = lists.groupBy("gram", "c").count().groupBy("gram").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    split = lists.join(mains, "gram")
    few, all_ = split.filter("c <> main").alias("x"), split.alias("y")
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    joined = few.join(all_, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.c") != F.col("y.c")) & once & _possible("x", "y"))
    return _ordered(joined.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))


def needed_overlap(na: int, nb: int) -> int:
    return (4 * (na + nb) + 8) // 9


def apart(x: np.ndarray, y: np.ndarray) -> bool:
    """The suffix filter: cut both sets at the same hashes; the sizes' differences bound how far the sets differ."""
    shift = np.uint64(64 - (CELLS.bit_length() - 1))
    difference = np.bincount((x >> shift).astype(np.int64), minlength=CELLS) - np.bincount((y >> shift).astype(np.int64), minlength=CELLS)
    return int(np.abs(difference).sum()) > len(x) + len(y) - 2 * needed_overlap(len(x), len(y))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if not len(x) or not len(y) or apart(x, y):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int((y[at] == x).sum()) >= needed_overlap(len(x), len(y))


def verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """The written pairs ``a, b`` whose whole sets reach the similarity."""
    nodes = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "paired")
    if nodes.count() <= BROADCAST_ROWS:
        nodes = F.broadcast(nodes)
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])
    link = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(batches):
        for batch in hands(batches):
            found = shingle_sets(batch.column("text").to_pylist(), words)
            yield record(schema, node=batch.column("doc_id"), grams=[s.tobytes() for s in found])

    def compare(batches):
        def of(raw: bytes) -> np.ndarray:
            return np.frombuffer(raw, dtype=np.uint64)

        for batch in hands(batches, "gb"):
            found = [(a, b) for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ga", "gb")), strict=True) if similar(of(x), of(y))]
            yield record(link, a=[p[0] for p in found], b=[p[1] for p in found])

    known = mapped(docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi"), sets, "node long, grams binary")
    both = pairs.join(known.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(
        known.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb")
    return written(mapped(both, compare, "a long, b long").distinct(), "links")


def linked(docs: DataFrame, words: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts of all documents, the class of each (``doc_id, rep``), and links between classes that span their components."""
    made = written(facts(docs, words), "facts")
    counts = added_up(made, 1 << BUCKET_BITS)
    known = made.filter("chunk is null")
    sets = known.filter("doc_id is not null and n > 0")
    reps = sets.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"))
    of_doc = written(sets.join(reps, ["key1", "key2"]).select("doc_id", "rep").distinct(), "classes")
    dealt = postings(docs, counts, words).repartition("gram", "salt").sortWithinPartitions("gram").select(*_LIST_SCHEMA.names, "salts")
    lists = written(mapped(dealt, shared_only, _LIST), "lists")
    # A posting is its own class's: a doc_id may have several.
    lists = written(lists.join(reps, ["key1", "key2"]).groupBy("gram", F.col("rep").alias("node"), "n").agg(F.min("pos").alias("pos")), "lists")
    # How many of a set's prefix shingles (a fifth of it) others share, in thousandths.
    shares = lists.groupBy("node", "n").agg(F.count("*").alias("k")).select(
        "node", "n", F.floor(5000 * F.col("k") / F.col("n")).cast("int").alias("shared"))
    lists = lists.join(shares, ["node", "n"])
    none = docs.sparkSession.createDataFrame([], "a long, b long")
    links, tried, turn, more = none, none, 0, True
    while more:
        lists = parted(lists, components(links))
        more = turn < STAR_ROUNDS
        pairs = written((star_round(lists, turn) if more else last_round(lists)).join(tried, ["a", "b"], "left_anti"), "tried")
        found = verified(docs, pairs, words)
        if more and found.isEmpty():
            turn = STAR_ROUNDS - 1  # stars find no more: what is left takes all pairs
        links, tried, turn = links.unionByName(found), tried.unionByName(pairs), turn + 1
    return known, of_doc, links


def jaccard_components(docs: DataFrame, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    known, of_doc, links = linked(docs, words)
    repeated = of_doc.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = of_doc.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    # A class is a star around its least id: it needs no rounds, but where a doc_id has several classes.
    placed = components(links.unionByName(repeated.join(several, F.col("a") == F.col("doc_id"), "left_semi")))
    top = of_doc.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(placed.withColumnRenamed("node", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("component"))
    return known.join(top, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
