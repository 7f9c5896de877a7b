"""Token ids in binary shard files with constant-time access by document key.

Documents are dealt by range of their key and sorted, so shard files hold them in ascending
order. A task writes one shard: the raw ids of its rows, then an index. The index is a minimal
perfect hash of the shard's distinct keys: level after level of bits, a key being settled at
the first level where no other one falls on its bit; the rank of that bit is the key's slot. A
slot holds a fingerprint, which tells absent keys, and the first row with the key. A reader
finds a key's shards by the shards' bounds, its slot by a few bits, and its ids by two offsets.

A shard file, all numbers little-endian::

    payload       ids, uint16 or uint32, row after row
    bits          uint8, the levels' bits, each level a multiple of 64
    ranks         uint64, ones before every 64 bits
    fingerprints  uint64 per slot
    first_rows    uint64 per slot
    starts        uint64 per row and one more, in ids
    tail          JSON: levels, sections; then its length as uint32 and MAGIC

Files get names of their own for every attempt of a task; only those named in the manifest,
a table that Spark commits, count.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.pieces import tokenizer, vocabulary
from lakecheck.llm.registry import query, table
from lakecheck.llm.tokencount import PreTokens
from lakecheck.session import materialize, scratch_path
from lakecheck.sources.tables import open_path, open_sink

MAGIC, END_ID = b"TOKSHRD1", 1
#: Text bytes of a shard, and the most shards: their bounds are known to the driver and all tasks.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 65_536
#: Words whose ids a worker remembers; beyond it the memory starts anew.
MOST_KNOWN = 1_000_000
#: Payload bytes that a reader asks for at once, if a single row isn't longer.
READ_BYTES = 8 << 20
MANIFEST = "shard long, path string, n_rows long, n_null long, n_ids long, first_key long, last_key long"
FOUND = "doc_id long, start long, ids binary"
_SECTIONS = ("bits", "ranks", "fingerprints", "first_rows", "starts")


# --- the hash -----------------------------------------------------------------------------


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers: different keys never give the same number."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots 0..n-1 of n distinct keys. Space: about 3.1 bits a key and its ranks; a key is
    settled at level 1 with a chance of 0.6, and so on."""

    def __init__(self, levels: list[int], bits: np.ndarray, ranks: np.ndarray):
        self.levels, self.bits, self.ranks = levels, bits, ranks

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels, planes = [], []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            at = (mixed(keys, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(size)
            planes.append(np.packbits(alone, bitorder="little"))
            keys = keys[~alone[at]]
        bits = np.concatenate(planes) if planes else np.zeros(0, np.uint8)
        ones = np.bitwise_count(bits.view("<u8")).astype(np.int64)
        return cls(levels, bits, (np.cumsum(ones) - ones).astype("<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; of a key that isn't there any slot, or -1."""
        out, base = np.full(len(keys), -1, np.int64), 0
        words, left = self.bits.view("<u8"), np.arange(len(keys))
        for level, size in enumerate(self.levels, 1):
            at = base + (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = self.ranks[at[hit] >> 6].astype(np.int64) + below[hit]
            left, base = left[~hit], base + size
        return out


def index_of(keys: list[int | None], lengths: list[int]) -> tuple[dict, dict[str, np.ndarray]]:
    """Tail and sections for rows in ascending order of their keys, nulls first."""
    n_null = sum(k is None for k in keys)
    own = np.array(keys[n_null:], np.int64)
    distinct, first = np.unique(own, return_index=True)
    hashed = PerfectHash.of(distinct)
    slot = hashed.slots(distinct)
    prints, rows = np.zeros(len(distinct), "<u8"), np.zeros(len(distinct), "<u8")
    prints[slot], rows[slot] = mixed(distinct, 0), first + n_null
    starts = np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]).astype("<u8")
    sections = dict(zip(_SECTIONS, (hashed.bits, hashed.ranks, prints, rows, starts), strict=True))
    return {"levels": hashed.levels, "n_null": n_null, "sections": [x.nbytes for x in sections.values()]}, sections


class Shard:
    """An open shard: its index in memory, its payload in the file."""

    def __init__(self, handle):
        self.handle, size = handle, handle.size()
        handle.seek(size - 12)
        end = handle.read(12)
        if end[4:] != MAGIC:
            raise ValueError("not a shard file, or not whole")
        n = int.from_bytes(end[:4], "little")
        handle.seek(size - 12 - n)
        self.tail = json.loads(handle.read(n))
        at = size - 12 - n - sum(self.tail["sections"])
        handle.seek(at)
        parts = {}
        for name, length in zip(_SECTIONS, self.tail["sections"], strict=True):
            parts[name] = np.frombuffer(handle.read(length), np.uint8 if name == "bits" else "<u8")
        self.hash = PerfectHash(self.tail["levels"], parts["bits"], parts["ranks"])
        self.prints, self.first_rows, self.starts = parts["fingerprints"], parts["first_rows"].astype(np.int64), parts["starts"].astype(np.int64)
        self.dtype = np.dtype(self.tail["dtype"])
        # a key's rows end where those of the next key begin
        order = np.sort(self.first_rows)
        self.next_row = np.append(order, len(self.starts) - 1)[np.searchsorted(order, self.first_rows) + 1]

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(key number, first row, row after the last)`` of the keys that are there."""
        slot = self.hash.slots(keys)
        at = np.flatnonzero(slot >= 0)
        at = at[self.prints[slot[at]] == mixed(keys[at], 0)]
        return at, self.first_rows[slot[at]], self.next_row[slot[at]]

    def read(self, rows: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """``(row, start, ids as uint32)`` of rows in ascending order; rows that lie near each
        other are read at once."""
        width, first = self.dtype.itemsize, 0
        while first < len(rows):
            begin = self.starts[rows[first]]
            last = int(np.searchsorted(self.starts[rows + 1], begin + READ_BYTES // width, "right"))
            last = max(first + 1, last)
            block = rows[first:last]
            self.handle.seek(int(begin) * width)
            data = np.frombuffer(self.handle.read(int(self.starts[block[-1] + 1] - begin) * width), self.dtype)
            for row in block.tolist():
                low, high = int(self.starts[row]), int(self.starts[row + 1])
                yield row, low, data[low - begin : high - begin].astype("<u4").tobytes()
            first = last


# --- encoding -----------------------------------------------------------------------------


class WordIds(dict):
    """Ids of words between ASCII white space, for a tokenizer whose pieces never cross it."""

    def __init__(self, library: str, dtype: np.dtype):
        self.lib, self.dtype = tokenizer(vocabulary(library)), dtype
        self.cut, self.model, self.pieces = PreTokens(self.lib), self.lib.model, {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_KNOWN:
            self.clear()
            self.pieces.clear()
        self[word] = out = b"".join(map(self.piece, self.cut(word.decode())))
        return out

    def piece(self, p: str) -> bytes:
        out = self.pieces.get(p)
        if out is None:
            if p[:1] == " ":  # a word with a special token in it
                ids = self.lib.encode(p[1:], add_special_tokens=False).ids
            else:
                ids = [t.id for t in self.model.tokenize(p)]
            self.pieces[p] = out = np.array(ids, self.dtype).tobytes()
        return out


def id_type(library: str) -> np.dtype:
    """The smaller of two types that holds all ids."""
    return np.dtype("<u2" if tokenizer(vocabulary(library)).get_vocab_size() <= 1 << 16 else "<u4")


def _write(folder: str, library: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = id_type(library)
        known, end = WordIds(library, dtype), np.array([end_id], dtype).tobytes()
        keys, lengths, out = [], [], None
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        for batch in batches:
            if out is None and batch.num_rows:
                out = open_sink(path)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                ids = b"".join([known[w] for w in (text.as_py() or b"").split()]) + end
                out.write(ids)
                keys.append(key)
                lengths.append(len(ids) // dtype.itemsize)
        if out is None:
            return
        tail, sections = index_of(keys, lengths)
        for section in sections.values():
            out.write(section.tobytes())
        note = json.dumps(tail | {"dtype": dtype.str}).encode()
        out.write(note + len(note).to_bytes(4, "little") + MAGIC)
        out.close()
        own = keys[tail["n_null"] :]
        row = [shard, path, len(keys), tail["n_null"], sum(lengths), own[0] if own else None, own[-1] if own else None]
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if n == "path" else pa.int64()) for n, x in zip(names, row, strict=True)], names)

    return run


def write_ids(
    docs: DataFrame, folder: str | None = None, text_col: str = "text", id_col: str = "doc_id", library: str = "word_bpe_49k.json",
    end_id: int = END_ID, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode all rows and write them to shard files; returns the manifest, one row per file:
    ``shard, path, n_rows, n_null, n_ids, first_key, last_key``.

    Rows lie in ascending order of the key (an integer), nulls first; a row's ids are those of
    the library without added special tokens, then ``end_id``. Null text is the empty text,
    ``end_id`` alone. Rows with the same key are all kept, next to each other, and may spread
    over several shards; equal rows are interchangeable. A very long text is one row of one
    shard. No rows in: no shards. Other columns are not read. ``folder`` is one that all
    executors share; without it one below ``spark.checkpoint.dir`` is taken.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(MOST_SHARDS, max(math.ceil(size / shard_bytes), spark.sparkContext.defaultParallelism))
    # a key with very many rows spreads over shards, equal rows too
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("_place")]
    placed = slim.withColumn("_place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ranged.mapInArrow(_write(folder, library, end_id), MANIFEST), "manifest")


# --- reading ------------------------------------------------------------------------------


def _bases(shards: list) -> np.ndarray:
    return np.cumsum([0, *(s.n_ids for s in shards)])[:-1]


def _route(first: np.ndarray, last: np.ndarray, numbers: np.ndarray, null_in: list[int]):
    """Shards whose bounds hold a key: several next to each other if its rows are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            keys = column.drop_null().to_numpy().astype(np.int64)
            low, high = np.searchsorted(last, keys, "left"), np.searchsorted(first, keys, "right")
            times = np.maximum(high - low, 0)
            at = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            shard = np.concatenate([numbers[at], np.array(null_in * column.null_count, np.int64)])
            key = pa.concat_arrays([pa.array(np.repeat(keys, times)), pa.nulls(len(null_in) * column.null_count, pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(shard), key], ["shard", "doc_id"])

    return run


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``path, base, doc_id`` that come sorted by path: one shard open at a time."""
    path, base, handle, asked = None, 0, None, []

    def answer() -> Iterator[pa.RecordBatch]:
        shard = Shard(handle)
        keys = np.array([k for k in asked if k is not None], np.int64)
        at, low, high = shard.rows(keys)
        order = np.argsort(low)
        at, low, times = at[order], low[order], (high - low)[order]
        # all rows of each key, behind those without a key
        n_null = shard.tail["n_null"] if len(keys) < len(asked) else 0
        wanted = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        of_key, rows, size = np.repeat(at, times), [], 0
        for i, (_, start, ids) in enumerate(shard.read(np.concatenate([np.arange(n_null), wanted]))):
            rows.append((int(keys[of_key[i - n_null]]) if i >= n_null else None, base + start, ids))
            size += len(ids)
            if size > READ_BYTES or len(rows) >= 10_000:
                yield _found(rows)
                rows, size = [], 0
        if rows:
            yield _found(rows)

    for batch in batches:
        for name, offset, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != path:
                if path is not None:
                    yield from answer()
                    handle.close()
                path, base, handle, asked = name, offset, open_path(name), []
            asked.append(key)
    if path is not None:
        yield from answer()
        handle.close()


def _found(rows: list[tuple]) -> pa.RecordBatch:
    keys, starts, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])


def read_ids(keys: DataFrame, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, start, ids`` of all rows whose key is in ``keys``, through the shards' indexes.

    ``start`` counts the ids of all rows before it in all shards, ``ids`` are little-endian
    unsigned 32-bit numbers, the end id included. A key that is asked for twice is answered
    once, one that isn't there not at all; the null key finds the rows without one. The
    shards' bounds (at most :data:`MOST_SHARDS` of them) go to all tasks.
    """
    spark = keys.sparkSession
    shards = manifest.orderBy("shard").collect()  # one row per file, at most MOST_SHARDS
    bases = _bases(shards).tolist()
    keyed = [s for s in shards if s.first_key is not None]
    first, last, numbers = (np.array([s[c] for s in keyed], np.int64) for c in ("first_key", "last_key", "shard"))
    null_in = [s.shard for s in shards if s.n_null]
    asked = keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    routed = asked.mapInArrow(_route(first, last, numbers, null_in), "shard long, doc_id long")
    places = spark.createDataFrame([(s.shard, s.path, b) for s, b in zip(shards, bases, strict=True)], "shard long, path string, base long")
    dealt = routed.join(F.broadcast(places), "shard").select("path", "base", "doc_id")
    by_shard = dealt.repartition(max(1, len(shards)), "path").sortWithinPartitions("path", "doc_id")
    return by_shard.mapInArrow(_look_up, FOUND)


@query
def op13_token_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = read_ids(docs.select("doc_id"), write_ids(docs))
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
