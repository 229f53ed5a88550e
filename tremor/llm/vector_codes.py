"""Codes of vectors: each part of a vector becomes the index of its nearest codebook entry.

Lloyd rounds with resident members.  A part of a vector belongs to the owner of its position and
nearest entry; owners are dealt by (position, entry, salt), where the salt splits an entry that
many parts belong to.  The first placement is the only time that all parts are shuffled: an owner
adds up its resident members, which gives the next codebooks, compares its members with these,
and only parts whose entry changes migrate, as a further generation of members.  A generation is
a table in the shared folder and is never rewritten.  Whether a member of an earlier generation is
still resident follows from the codebooks since, which every owner has (they are bounded by
positions x entries).

Rows are dropped if the vector is null or holds null or non-finite components (see ``vectors`` for
vectors of several lengths).  Components are held within +-2^27 / 256, so that squares and sums fit a long.
Vectors whose length isn't a multiple of the number of parts are refused (ValueError).  Codebooks
start from the rows of the smallest ids, null ids after all others and rows of one id in order of
their components; with fewer rows than entries there are fewer entries.  Rows that repeat an id, or
have none, are each coded for themselves.  Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small, written
from .common import mapped, record
from .vectors import blocks, matrix_of, scaled, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
BOUND = 1 << 27
# Vectors to one salt: an owner has at most about so many members, however hot its entry is.
SALT_ROWS = 500_000
# Members of one row of a generation.
MEMBERS = 1024

_BLOCK = "position int, entry int, salt int, members binary, parts binary"
_SCHEMA = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("members", pa.binary()), ("parts", pa.binary())])
_SUM = "position int, entry int, n long, sums array<long>"
_SUM_SCHEMA = pa.schema([("position", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_CODE = "row long, position int, entry int, error long"
_CODE_SCHEMA = pa.schema([("row", pa.int64()), ("position", pa.int32()), ("entry", pa.int32()), ("error", pa.int64())])


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part, the lower one on ties, and the squared distance."""
    distance = np.zeros((len(parts), len(book)), dtype=np.int64)
    for j in range(parts.shape[1]):
        distance += (parts[:, j, None] - book[None, :, j]) ** 2
    best = distance.argmin(axis=1)
    return best, distance[np.arange(len(parts)), best]


def _packed(position: int, entries: np.ndarray, salts: np.ndarray, rows: np.ndarray, parts: np.ndarray):
    """Blocks of at most ``MEMBERS`` parts of one entry and salt."""
    order = np.lexsort((rows, salts, entries))
    entries, salts, rows, parts = entries[order], salts[order], rows[order], parts[order]
    edge = np.flatnonzero((np.diff(entries, prepend=-1) != 0) | (np.diff(salts, prepend=-1) != 0))
    for start, end in zip(edge, np.append(edge[1:], len(rows)), strict=True):
        for a in range(start, end, MEMBERS):
            b = min(a + MEMBERS, end)
            yield position, int(entries[a]), int(salts[a]), rows[a:b].tobytes(), parts[a:b].tobytes()


def _batch(made: list[tuple]) -> pa.RecordBatch:
    return record(_SCHEMA, **dict(zip(_SCHEMA.names, map(list, zip(*made, strict=True)), strict=True)))


def _members(batch: pa.RecordBatch, width: int):
    for position, entry, salt, rows, parts in zip(*(batch.column(c).to_pylist() for c in _SCHEMA.names), strict=True):
        yield position, entry, salt, np.frombuffer(rows, np.int64), np.frombuffer(parts, np.int64).reshape(-1, width)


def _resident(parts: np.ndarray, position: int, entry: int, since: list[np.ndarray]) -> np.ndarray:
    """Which members of a generation have stayed with their entry under the codebooks since."""
    here = np.ones(len(parts), dtype=bool)
    for books in since:
        here &= nearest(parts, books[position])[0] == entry
    return here


def placed(rows: DataFrame, width: int, books: np.ndarray, salts: int) -> DataFrame:
    """The first generation: every part with the owner of its nearest entry."""
    positions = len(books)

    def run(batches):
        for batch in blocks(batches, width):
            matrix = matrix_of(batch.column("x"), width)
            ids = batch.column("row").to_numpy()
            cut = matrix.reshape(len(matrix), positions, -1)
            made = []
            for p in range(positions):
                mine = np.ascontiguousarray(cut[:, p])
                made += _packed(p, nearest(mine, books[p])[0], ids % salts, ids, mine)
            yield _batch(made)

    return written(mapped(rows.select("row", "x"), run, _BLOCK).repartition("position", "entry", "salt"), "members")


def migrated(generation: DataFrame, width: int, since: list[np.ndarray], books: np.ndarray) -> DataFrame:
    """Members of a generation whose nearest entry under new codebooks is another one."""

    def run(batches):
        for batch in batches:
            made = []
            for position, entry, salt, rows, parts in _members(batch, width):
                best = nearest(parts, books[position])[0]
                go = _resident(parts, position, entry, since) & (best != entry)
                if go.any():
                    made += _packed(position, best[go], np.full(go.sum(), salt), rows[go], parts[go])
            if made:
                yield _batch(made)

    return mapped(generation, run, _BLOCK)


def added(generation: DataFrame, width: int, since: list[np.ndarray]) -> DataFrame:
    """Owners' sums of the resident members of a generation."""

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for position, entry, _, _, parts in _members(batch, width):
                here = parts[_resident(parts, position, entry, since)]
                if len(here):
                    both = np.append(here.sum(axis=0), len(here))
                    sums[position, entry] = sums.get((position, entry), 0) + both
        keys = list(sums)
        yield record(_SUM_SCHEMA, position=[p for p, _ in keys], entry=[e for _, e in keys],
                     n=[int(sums[k][-1]) for k in keys], sums=[sums[k][:-1].tolist() for k in keys])

    return mapped(generation, run, _SUM)


def updated(sums: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of floored means; an entry without members stays.  One row an entry comes to the driver."""
    width = books.shape[2]
    total = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    new = books.copy()
    for row in total.collect():
        new[row["position"], row["entry"]] = [row[f"s{j}"] // row["n"] for j in range(width)]
    return new


def coded(generation: DataFrame, width: int, since: list[np.ndarray], books: np.ndarray) -> DataFrame:
    """Entry and squared distance of every resident member under the final codebooks."""

    def run(batches):
        for batch in batches:
            for position, entry, _, rows, parts in _members(batch, width):
                here = _resident(parts, position, entry, since)
                best, error = nearest(parts[here], books[position])
                yield record(_CODE_SCHEMA, row=pa.array(rows[here]), position=pa.array(np.full(len(best), position, np.int32)),
                             entry=pa.array(best.astype(np.int32)), error=pa.array(error))

    return mapped(generation, run, _CODE)


def whole_numbers(embeddings: DataFrame, vector: str, key: str, label: str) -> tuple[DataFrame, int]:
    """``row, vec_id, label, x`` of the usable rows, written once, and the vectors' length."""
    kept, width = usable(embeddings, vector)
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.int64()))])

    def run(batches):
        for batch in blocks(batches, width):
            x = scaled(matrix_of(batch.column("v"), width), SCALE, BOUND)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * width)
            yield record(schema, row=batch.column("row"), vec_id=batch.column("vec_id"), label=batch.column("label"),
                         x=pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))))

    named = kept.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
    return written(mapped(named, run, "row long, vec_id long, label int, x array<long>"), "vectors"), width


def lloyd(rows: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[list[DataFrame], list[np.ndarray]]:
    """The generations of members, and the codebooks before each of them and after the last."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    books = [np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)]
    size = width // parts
    generations = [placed(rows, width, books[0], max(1, math.ceil(rows.count() / SALT_ROWS)))]
    for turn in range(rounds):
        sums = None
        for g, generation in enumerate(generations):
            here = added(generation, size, books[g + 1:])
            sums = here if sums is None else sums.unionByName(here)
        new = updated(sums, books[-1])
        if turn + 1 < rounds:
            moves = None
            for g, generation in enumerate(generations):
                gone = migrated(generation, size, books[g + 1:], new)
                moves = gone if moves is None else moves.unionByName(gone)
            generations.append(written(moves.repartition("position", "entry", "salt"), "members"))
        books.append(new)
    return generations, books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable row."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: from 1 to 256 entries")
    rows, width = whole_numbers(embeddings, vector, key, label)
    if width % parts or not width:
        if rows.isEmpty():
            none = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
            return embeddings.sparkSession.createDataFrame([], none)
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    generations, books = lloyd(rows, width, parts, entries, rounds)
    size, found = width // parts, None
    for g, generation in enumerate(generations):
        # The last codebooks are compared with here; nothing has moved for them.
        here = coded(generation, size, books[g + 1:-1], books[-1])
        found = here if found is None else found.unionByName(here)
    place = [F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"p{p}") for p in range(parts)]
    code = F.concat(*[F.lower(F.lpad(F.hex(f"p{p}"), 2, "0")) for p in range(parts)])
    by_row = found.groupBy("row").agg(F.sum("error").alias("error"), *place).select("row", "error", code.alias("code"))
    out = written(rows.select("row", "vec_id", "label").join(by_row, "row"), "codes")
    by_label = written(out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = out.join(small(by_label), out["label"].eqNullSafe(by_label["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_digest(books[-1])).alias("codebooks_sha256"))
