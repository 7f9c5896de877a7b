"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Each of the 64 bits gets a non-zero code of radius + 1 bits. Every non-zero vector v of that
length makes one table, whose mask has the bits with an odd number of ones in common with v
(2 ** (radius + 1) - 1 tables). Two fingerprints that differ in ``radius`` bits at most
give as many codes at most, and some v is orthogonal to all of them: in that table the mask
hides all the bits they differ in, and their keys are equal. No pair is lost.

Fingerprints, not documents, are hashed, each once. A bucket is searched in the task that
holds it, from one fingerprint to those in reach and on from these, so that it yields at most
one link less than it has members. A bucket too large for this is dealt again by the same
masks over the bits that its key leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.llm.components import components
from lakecheck.llm.registry import query, table
from lakecheck.session import fits_broadcast, materialize

BITS, RADIUS, SHINGLE = 64, 3, 3
#: Larger buckets are dealt again, at most so many times.
MOST_IN_BUCKET, MOST_ROUNDS = 512, 3
_LINKS = "a long, b long"


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of a whole text as a signed 64-bit number; no words: zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts, last = [0, *ends[:-1]], max(len(words) - width, 0)
    hashes = [xxhash.xxh64_intdigest(line[s : e - 1], 42) for s, e in zip(starts[: last + 1], ends[min(width, len(words)) - 1 :], strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """One mask per table, over the given bits (all 64 if None), as signed numbers."""
    free = list(range(BITS)) if bits is None else bits
    n = 1 << (radius + 1)
    codes = {bit: 1 + at % (n - 1) for at, bit in enumerate(free)}
    out = [sum(1 << bit for bit, code in codes.items() if (code & v).bit_count() % 2) for v in range(1, n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


@cache
def _finer(mask: int, radius: int) -> list[int]:
    """The key's mask with those of the tables over the bits that it leaves open."""
    open_bits = [b for b in range(BITS) if not mask >> b & 1]
    return sorted({mask | m for m in masks(radius, open_bits)})


def _reach(values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is in reach of each other: a tree for each component."""
    rest, todo = values, []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        near = np.bitwise_count(rest ^ todo[-1]) <= radius
        one, found = todo.pop(), rest[near]
        if len(found):
            yield np.full(len(found), one, np.uint64), found
            todo += found.tolist()
            rest = rest[~near]


def _link_buckets(radius: int):
    """Rows come sorted by (mask, key): buckets follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            sizes = np.diff(np.append(first, len(keys)))
            small = first[sizes == 2]
            near = np.bitwise_count(values[small] ^ values[small + 1]) <= radius
            a, b = [values[small][near]], [values[small + 1][near]]
            for at, n in zip(first[sizes > 2], sizes[sizes > 2], strict=True):
                for left, right in _reach(values[at : at + n], radius):
                    a.append(left), b.append(right)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

        keys, values = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            mask, key, value = (c.to_numpy() for c in batch.columns)
            value = value.view(np.uint64)  # signed numbers would be counted without their sign
            keys, values = np.concatenate([keys, np.stack([mask, key], 1)]), np.concatenate([values, value])
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1)).max(initial=-1)) + 1  # the last bucket may go on
            if cut:
                yield links(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield links(keys, values)

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, most: int = MOST_IN_BUCKET) -> DataFrame:
    """``a, b``: enough pairs of distinct fingerprints in reach to join all that are.

    ``prints`` is a written table with one row for each distinct ``fp``.
    """
    found, dealt = [], prints.select("fp", F.explode(F.array(*map(F.lit, masks(radius)))).alias("mask"))
    for turn in range(MOST_ROUNDS + 1):
        keyed = dealt.withColumn("key", F.col("mask").bitwiseAND(F.col("fp")))
        size = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        size = materialize(size, "buckets")
        large = size.where(F.col("n") > most).drop("n") if turn < MOST_ROUNDS else size.limit(0).drop("n")
        small = size.join(large, ["mask", "key"], "left_anti").drop("n")
        several = keyed.join(F.broadcast(small) if fits_broadcast(small) else small, ["mask", "key"], "left_semi")
        # a further column of the key, so that this is not the exchange of the join
        at_hand = several.withColumn("part", F.hash("mask", "key", F.lit(turn))).repartition("part").sortWithinPartitions("part", "mask", "key", "fp")
        found.append(materialize(at_hand.select("mask", "key", "fp").mapInArrow(_link_buckets(radius), _LINKS), "near"))
        if not large.take(1):
            break
        hot = keyed.join(F.broadcast(large) if fits_broadcast(large) else large, ["mask", "key"], "left_semi")

        @F.pandas_udf("array<long>")
        def finer(old: pd.Series) -> pd.Series:
            return old.map(lambda mask: _finer(mask, radius))

        dealt = materialize(hot.select("fp", F.explode(finer("mask")).alias("mask")).distinct(), "dealt")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def fingerprints(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("fp"))


def near_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest identifier reachable over links of ``radius`` or fewer
    differing bits, null if no identifier of the component is known. Null text is the empty
    text: like all texts without words it has fingerprint zero and is linked like others.
    Repeated rows are in one component. No rows in: no rows out. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, text_col, id_col), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_links(prints.select("fp"), radius))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a component can hold very many fingerprints: aggregated before the shuffle
    least = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_print = materialize(named.join(F.broadcast(least) if fits_broadcast(least) else least, "root").select("fp", "component_id"), "classes")
    out = rows.join(F.broadcast(of_print) if fits_broadcast(of_print) else of_print, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` with the row of the smallest identifier of each component, all columns as they
    were; of rows that share it, one stays. Rows without an identifier stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    rows = materialize(rows, "numbered")
    ids = rows.select(F.col(f"_doc.`{id_col}`").alias("doc_id"), "_row")
    groups = materialize(near_groups(rows.select("_doc.*"), text_col, id_col, radius).where("doc_id IS NOT NULL").select("doc_id", "component_id").distinct(), "groups")
    stays = groups.where("doc_id = component_id").select("doc_id").distinct()
    first = ids.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("_row").alias("_row")).join(stays, "doc_id").select("_row")
    gone = materialize(ids.where("doc_id IS NOT NULL").select("_row").join(first, "_row", "left_anti"), "copies")
    left = rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "_row", "left_anti")
    return left.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


@query
def op2_simhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents"))
