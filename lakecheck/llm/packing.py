"""Harmonic packing of token streams into sequences of a fixed capacity.

A piece of length n belongs to class ``capacity // n``: as many such pieces fit into one bin,
so a bin takes exactly that many of its class, in any order, and no search is needed. Texts
may be cut, so their pieces are given lengths that fill a bin: ``capacity``, its halves down
to ``2 * grain``, and one last piece of ``grain`` to ``2 * grain - 1`` tokens.

Workers fill bins of their own. What they leave (fewer pieces of a class than a bin takes) is
dealt to a few workers which fill bins again. These cut their last leavings into powers of
two and close them as sequences of such a length, which need no padding.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.pieces import byte_bpe_ids, vocabulary
from lakecheck.llm.registry import query, table
from lakecheck.session import materialize

CAPACITY, GRAIN, END_ID = 2048, 32, 1
#: Left pieces that one worker of the second round takes.
LEFT_PER_TASK = 16_384

#: ``ids`` holds the tokens of left pieces that may be cut once more.
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in PLACED.split(", ")])


def piece_lengths(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[int]:
    """Lengths that a text of n tokens is cut into."""
    out, rest = [capacity] * (n // capacity), n % capacity
    size = capacity // 2
    while size >= 2 * grain:
        if rest >= size + grain or rest == size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def _powers(n: int) -> list[int]:
    return [1 << b for b in reversed(range(n.bit_length())) if n >> b & 1]


class Bins:
    """The open bin of every class; closed ones wait in ``rows``."""

    def __init__(self, first_id: int, capacity: int):
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []
        self.next_id, self.capacity = first_id, capacity

    def add(self, piece: tuple) -> None:
        kind = self.capacity // piece[2]
        pieces = self.open.setdefault(kind, [])
        pieces.append(piece)
        if len(pieces) == kind:
            self.close(self.open.pop(kind))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, length, crc, total, _ in pieces:
            self.rows.append((doc, start, length, crc, total, self.next_id, offset, None))
            offset += length
        self.next_id += 1

    def left(self) -> Iterator[tuple]:
        for pieces in self.open.values():
            for *piece, ids in pieces:
                yield (*piece, None, None, ids)
        self.open = {}

    def close_rest(self) -> None:
        """Close everything in sequences that are full or a power of two long."""
        for kind in [k for k in self.open if k & (k - 1) or self.capacity % k]:
            for piece in self.open.pop(kind):
                self._cut(piece)
        for kind in [k for k in self.open if any(p[2] != self.capacity // k for p in self.open[k])]:
            for piece in self.open.pop(kind):
                self._cut(piece)
        for kind in sorted(self.open):
            pieces = self.open.pop(kind)
            for run in _powers(len(pieces)):
                self.close(pieces[:run])
                pieces = pieces[run:]

    def _cut(self, piece: tuple) -> None:
        doc, start, _, _, total, ids = piece
        for n in _powers(len(ids) // 4):
            self.add((doc, start, n, zlib.crc32(ids[: 4 * n]), total, ids[: 4 * n]))
            start, ids = start + n, ids[4 * n :]

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield _batch(self.rows)
            self.rows = []


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _first_round(capacity: int, grain: int, library: str, ranks: str):
    exact = {capacity >> i for i in range(capacity.bit_length()) if capacity >> i >= 2 * grain}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId() << 32, capacity)
        paths = vocabulary(library), vocabulary(ranks)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(byte_bpe_ids(text.as_py() or "", *paths), np.uint32(END_ID)).astype("<u4").tobytes()
                start, total = 0, len(ids) // 4
                for n in piece_lengths(total, capacity, grain):
                    part = ids[4 * start : 4 * (start + n)]
                    bins.add((doc, start, n, zlib.crc32(part), total, None if n in exact else part))
                    start += n
                if len(bins.rows) > 20_000:
                    yield from bins.drain()
        bins.rows += bins.left()
        yield from bins.drain()

    return run


def _last_round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins((1 << 62) + (TaskContext.get().partitionId() << 32), capacity)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bins.add((*row[:5], row[7]))
            yield from bins.drain()
        bins.close_rest()
        yield from bins.drain()

    return run


def pack(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, grain: int = GRAIN,
    library: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A text's tokens are its ids and one end id; null text is the empty text, which is that id
    alone. Rows are packed one by one: a repeated row is packed again, a null identifier is
    kept. A long text fills whole sequences. No rows in: no rows out. Other columns are not
    read. ``capacity`` is a power of two and ``grain`` a smaller one.
    """
    if capacity & (capacity - 1) or grain & (grain - 1) or not 0 < 2 * grain <= capacity:
        raise ValueError("capacity and grain are powers of two, 2 * grain <= capacity")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = materialize(slim.mapInArrow(_first_round(capacity, grain, library, ranks), PLACED), "placed")
    left = placed.where("sequence_id IS NULL")
    tasks = max(1, math.ceil(left.count() / LEFT_PER_TASK))
    again = left.repartition(tasks).mapInArrow(_last_round(capacity), PLACED)
    return placed.where("sequence_id IS NOT NULL").union(again).drop("ids")


@query
def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
