"""Periodic runs of words, by maximal pairs.

A run is a stretch of consecutive words with smallest period q (words q apart are identical)
and a length of at least max(24, 3 q) that no neighbouring word extends keeping that period.

Two occurrences x < y of the same h words are a maximal pair if neither their left nor their
right neighbours agree. A pair at distance q <= h / 2 is a stretch of h + q words with period
q, and as the pair is maximal no word extends it: it is a run as it stands if h + q >= 24. The
smallest period of a stretch gives a pair of its own, so the least q of each stretch counts.

Pairs are read off the tree of LCP intervals of a text's suffixes, from the leaves up. An
interval of h common words holds the positions of its suffixes as a list in ascending order,
each labelled with its left word, its class. Where two children of an interval meet,
their positions have exactly h words in common, and pairs are those of different classes.
Positions at most h / 2 apart form a chain with steps of the words' smallest period, and inside
it all have the same left word but, at most, the first. So one look at each end of what is in
reach finds all pairs or none: the work follows the pairs found, and these are at most a third of
the length of a run by its period. The shorter list goes into the longer.

Intervals of under 16 words can't hold a run (24 - q <= h and 2 q <= h), so only texts in
which 16 words repeat, found for many texts at once by one sort of hashes, get a tree.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import query, table
from lakecheck.llm.words import WordHashes, words_of

SHORTEST, TIMES = 24, 3
#: Words of texts that are searched for repeats together; a longer text is alone.
TOGETHER = 1 << 20
SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, kept string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ARROW = pa.schema([(n, pa.int64()) for n in "doc_id n_words n_runs start length period exponent_milli".split()] + [("runs", pa.list_(_RUN)), ("kept", pa.string())])


def least_common(shortest: int, times: int) -> int:
    """The fewest words h that the two ends of a run have in common, over all periods q: at
    least ``shortest - q`` and ``(times - 1) q``."""
    return min(max(shortest - q, (times - 1) * q) for q in range(1, shortest + 1))


def suffixes(ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Suffixes in order, and the words that each has in common with the one before it."""
    n, step = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    while step < n and rank.max() < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    order, place, words = order.tolist(), rank.tolist(), ids.tolist()
    common, h = [0] * n, 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            most = n - max(i, j)
            while h < most and words[i + h] == words[j + h]:
                h += 1
            common[place[i]] = h
            h -= h > 0
        else:
            h = 0
    return order, common


def _meet(h: int, a: list[int], b: list[int], left: list[int], shortest: int, reach: int, found: dict) -> list[int]:
    """Record the pairs between two children of an interval of h words; their joint list."""
    if len(a) < len(b):
        a, b = b, a
    for x in b:
        i, j = bisect_left(a, x - reach), bisect_right(a, x + reach)
        k = bisect_left(a, x)
        near = a[i : i + 1] if i < k and left[a[i]] != left[x] else []  # the head of x's chain
        if k < j and left[a[k]] != left[x]:  # x is the head
            near = near + a[k:j]
        for y in near:
            q = y - x if y > x else x - y
            if h + q >= shortest:
                stretch = (x if x < y else y, h + q)
                if q < found.get(stretch, q + 1):
                    found[stretch] = q
    if len(b) * 16 < len(a):
        for x in b:
            insort(a, x)
        return a
    a += b
    a.sort()
    return a


def runs_of(ids: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a text of these words, in that order."""
    n, least = len(ids), least_common(shortest, times)
    if n < shortest:
        return []
    order, common = suffixes(ids)
    left = [-1, *ids.tolist()]  # class of a position: the word before it, none at the start
    found: dict[tuple[int, int], int] = {}
    heights, members = [], []
    for k in range(1, n + 1):
        h, child = common[k] if k < n else 0, [order[k - 1]]
        while heights and heights[-1] > h:
            top = heights.pop()
            child = _meet(top, members.pop(), child, left, shortest, top // (times - 1), found)
        if heights and heights[-1] == h:
            members[-1] = _meet(h, members[-1], child, left, shortest, h // (times - 1), found)
        elif h >= least:
            heights.append(h)
            members.append(child)
    return sorted((start, length, q) for (start, length), q in found.items())


def _repeating(hashes: list[np.ndarray], width: int) -> np.ndarray:
    """Which texts may hold the same ``width`` words twice (all that do, hardly any other)."""
    lengths = np.array([len(h) for h in hashes])
    windows = np.maximum(lengths - width + 1, 0)
    out = np.zeros(len(hashes), bool)
    if not windows.any():
        return out
    grams, span, factor = np.concatenate(hashes), 1, 0x9E3779B97F4A7C15
    starts = np.cumsum(lengths) - lengths
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    sums, covered = np.zeros(len(at), np.uint64), 0
    with np.errstate(over="ignore"):
        while True:  # a polynomial of each window, from those of spans that are powers of two
            if width & span:
                sums = sums * np.uint64(pow(factor, span, 1 << 64)) + grams[at + covered]
                covered += span
            if covered == width:
                break
            grams = grams[: len(grams) - span] * np.uint64(pow(factor, span, 1 << 64)) + grams[span:]
            span *= 2
        doc = np.repeat(np.arange(len(hashes)), windows)
        keys = sums ^ (doc.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    order = np.argsort(keys)
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    out[doc[order[same]]] = True
    return out


def _row(doc: int | None, words: list[str], runs: list[tuple[int, int, int]]) -> dict:
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    if runs:
        edge = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            edge[start + q] += 1
            edge[start + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return {
        "doc_id": doc, "n_words": None, "n_runs": len(runs), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": None if best[0] is None else 1000 * best[1] // best[2],
        "runs": [{"start": a, "length": b, "period": q} for a, b, q in runs], "kept": " ".join(words),
    }


def _search(shortest: int, times: int):
    least = least_common(shortest, times)

    def answer(docs: list[tuple], hashes: list[np.ndarray]) -> pa.RecordBatch:
        rows = []
        for (doc, words), own, repeats in zip(docs, hashes, _repeating(hashes, least).tolist(), strict=True):
            ids = np.unique(own, return_inverse=True)[1] if repeats else None
            if repeats and len(set(words)) != ids.max() + 1:  # two words with one hash: number the words themselves
                ids = np.array(list(map({w: i for i, w in enumerate(dict.fromkeys(words))}.__getitem__, words)))
            rows.append(_row(doc, words, runs_of(ids, shortest, times) if repeats else []) | {"n_words": len(words)})
        return pa.RecordBatch.from_pylist(rows, _ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, hashes, n = WordHashes(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                docs.append((doc, words))
                hashes.append(known(words))
                n += len(words)
                if n >= TOGETHER or len(docs) >= 10_000:
                    yield answer(docs, hashes)
                    docs, hashes, n = [], [], 0
        if docs:
            yield answer(docs, hashes)

    return run


def find_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shortest: int = SHORTEST, times: int = TIMES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_runs, start, length, period,
    exponent_milli, runs, kept``.

    ``runs`` are all runs by start and period, the four columns before it the one with the
    greatest length by period (ties: smallest start, then period), null if there is none.
    ``kept`` is the text, single spaces between its words, without the words that lie in a run
    after its first period. Null text has no words; an empty one neither, and no runs. Null
    identifiers and repeated rows give a row each. A whole text is searched by one task, in
    memory that grows with its words. Rows out as rows in: none for an empty table. Other
    columns are not read.
    """
    if times < 3:
        raise ValueError("times is at least 3: chains of positions have steps of one period then")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_search(shortest, times), SCHEMA)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` of all documents; in every tenth by a checksum of its number the words
    from some place on repeat a few words there. A document without a number stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    planted = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    planted = planted.select("doc_id", "text", "_words", (F.col("_g") % F.nullif(F.size("_words"), F.lit(0))).cast("int").alias("_a"), "_g")
    period = (1 + F.floor((F.size("_words") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int")
    planted = planted.select("*", period.alias("_p"))
    changed = F.transform(F.col("_words"), lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_words", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return planted.select("doc_id", F.when(F.size("_words") > 0, F.concat_ws(" ", changed)).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark, sf_dir):
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
