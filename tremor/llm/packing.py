"""Packing of token pieces into sequences: bounded-space best fit.

A packer keeps a fixed number of open sequences in a bitset keyed by free space.  A piece goes
to the open sequence that it fills most; if none has room it opens one, and if that is one too
many the fullest closes.  Pieces come in an order drawn from a hash of their ids, so large and
small ones alternate, and each packer is fed about ``PIECES`` of them: few sequences are still
open when it ends.

Null texts count as empty, rows that repeat a doc_id are packed each for itself, a null doc_id
is packed like any other, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import hands, mapped, record
from .tokens import MODEST, Memory, encoder

LENGTH = 2048
# Open sequences of a packer, and the pieces that a packer is to get.
OPEN = 4096
PIECES = 60_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECE + ", sequence_id long, offset long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: only the first may be shorter than ``length``."""
    first = (n - 1) % length + 1
    return [(0, first), *((at, length) for at in range(first, n, length))]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, memory: Memory = MODEST) -> DataFrame:
    """The pieces of every whole text with the end id, and the checksum of each."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        encode, end = encoder(tokenizer, memory).encode, np.array([end_id], dtype="<u4").tobytes()
        for batch in hands(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                raw = memoryview(encode(text) + end)
                rows += [(doc_id, i, at, n, zlib.crc32(raw[4 * at:4 * (at + n)])) for i, (at, n) in enumerate(cut(len(raw) // 4, length))]
            yield record(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return mapped(docs.select("doc_id", "text"), run, _PIECE, tokens=True)


class Packer:
    """Online best fit over at most ``bins`` open sequences of ``length`` ids."""

    def __init__(self, length: int = LENGTH, bins: int = OPEN):
        self.length, self.bins, self.opened, self.count = length, bins, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.levels = 0  # bit k: some open sequence has k ids of free space

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.levels ^= 1 << free
        self.count -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for a piece of ``size`` ids."""
        room = self.levels >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.length, self.opened
            self.opened += 1
        left = free - size
        if left:
            self.by_free[left].append(bin_)
            self.levels |= 1 << left
            self.count += 1
            if self.count > self.bins:
                self._take((self.levels & -self.levels).bit_length() - 1)
        return bin_, self.length - free


def packed(cut_pieces: DataFrame, length: int = LENGTH, bins: int = OPEN, per_packer: int = PIECES) -> DataFrame:
    """Every piece with its sequence and its place there; the pieces are read twice."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        packer, base = Packer(length, bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [packer.place(n) for n in batch.column("length").to_pylist()]
            if places:
                at, offset = zip(*places, strict=True)
                yield record(schema, **{c: batch.column(c) for c in schema.names[:5]}, sequence_id=[base + b for b in at], offset=list(offset))

    packers = max(1, math.ceil(cut_pieces.count() / per_packer))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut_pieces.repartition(packers, order).sortWithinPartitions(order, *cut_pieces.columns)
    return mapped(dealt, run, _PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, bins: int = OPEN, per_packer: int = PIECES,
         memory: Memory = MODEST) -> DataFrame:
    """Cut and pack all documents.  The pieces (numbers only) are written once to the shared folder."""
    return packed(written(pieces(docs, tokenizer, end_id, length, memory), "pieces"), length, bins, per_packer)
