"""Substring dedup: recurring phrases are found with Aho-Corasick automata.

A window of ``width`` words is represented by the smallest hash among its phrases of
``PHRASE`` words: equal windows have the same one, wherever they stand. Documents are dealt
to blocks, and then

1. every block names the phrases that represent a window of it; those named by several
   blocks recur;
2. every block compiles its recurring phrases into an automaton (the shards: no automaton
   holds more than its block), streams its documents through it, and names the windows
   that a located phrase represents, each with the smallest identifier that has it;
3. windows of several blocks are compared by two hashes, and the blocks learn which of
   theirs start in a document with a smaller identifier elsewhere;
4. the blocks do the same among their own documents and remove the words.

What the blocks exchange is one entry per block for a phrase or window, however often it
occurs in it, packed in arrays by ranges of a hash. Texts are shuffled once, by block.
"""

from __future__ import annotations

import hashlib
import math

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import query, table
from lakecheck.llm.words import WordHashes, words_of

WIDTH, PHRASE = 50, 8
BLOCK_BYTES = 8 << 20
_LAST = int(np.iinfo(np.int64).max)  # stands for no identifier: later than all
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers; a worker keeps the longest list it has made."""
    if base not in _tables or len(_tables[base]) < n:
        _tables[base] = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(max(n, 1 << 14), base, np.uint64)))
    return _tables[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(h: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """Hashes of all runs of ``width`` words, from differences of one running sum."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, len(h)))])
    back = _powers(pow(base, -1, 1 << 64), len(h) - width + 1)  # undoes the power of a run's place
    return _mixed((sums[width:] - sums[:-width]) * back)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


class Texts:
    """The long enough documents of a block: words, joined by single spaces, and their hashes."""

    def __init__(self, block: pd.DataFrame, width: int):
        hashes = WordHashes()
        self.lines: list[str] = []
        self.hashed: list[np.ndarray] = []
        ids = []
        for doc, text in zip(block["doc_id"].to_numpy(np.int64).tolist(), block["text"], strict=True):
            words = words_of(text)
            if len(words) >= width:
                ids.append(doc), self.lines.append(" ".join(words)), self.hashed.append(hashes(words))
        self.ids = np.array(ids, np.int64)

    def grams(self, width: int, base: int = _BASES[0]) -> list[np.ndarray]:
        return [gram_hashes(h, width, base) for h in self.hashed]


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _packed(block: int, part: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """A row for each part in use, with what the columns have for it."""
    order = np.argsort(part, kind="stable")
    parts, starts = np.unique(part[order], return_index=True)
    cut = [np.split(c[order], starts[1:]) if len(starts) else [] for c in columns]
    return pd.DataFrame({"part": parts.astype(np.int64), "block": np.full(len(parts), block, np.int64)} | {f"c{i}": [x.tobytes() for x in c] for i, c in enumerate(cut)})


def _unpacked(rows: pd.DataFrame, *kinds) -> tuple[np.ndarray, ...]:
    """The block of each entry, and the columns."""
    columns = [np.frombuffer(b"".join(rows[f"c{i}"]), k) for i, k in enumerate(kinds)]
    return np.repeat(rows["block"].to_numpy(np.int64), [len(x) // 8 for x in rows["c0"]]), *columns


def _name_phrases(width: int, parts: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        grams = Texts(block, width).grams(PHRASE)
        named = np.unique(_joined([sliding_min(g, width - PHRASE + 1) for g in grams], np.uint64))
        return _packed(block["block"].iloc[0], named % np.uint64(parts), named)

    return run


def _recurring(rows: pd.DataFrame) -> pd.DataFrame:
    blocks, phrases = _unpacked(rows, np.uint64)
    _, at, n = np.unique(phrases, return_inverse=True, return_counts=True)
    several = n[at] > 1
    out = [_packed(b, np.zeros(int(mine.sum()), np.int64), phrases[mine]) for b in np.unique(blocks[several]) if (mine := several & (blocks == b)).any()]
    return pd.concat(out) if out else _packed(0, *[np.zeros(0, np.int64)] * 2)


def _word_ends(line: str) -> np.ndarray:
    """Of the space behind each word, in a line with a space before and behind."""
    return np.cumsum(np.fromiter(map(len, line.split(" ")), np.int64) + 1)


def _automaton(lines: list[str], grams: list[np.ndarray], phrases: np.ndarray) -> ahocorasick.Automaton:
    """Of the block's own wording of the phrases."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    every = _joined(grams, np.uint64)
    here = np.flatnonzero(phrases[np.minimum(np.searchsorted(phrases, every), len(phrases) - 1)] == every)
    places = here[np.unique(every[here], return_index=True)[1]]
    starts = np.concatenate([[0], np.cumsum([len(g) for g in grams])])
    docs = np.searchsorted(starts, places, "right") - 1
    for doc in np.unique(docs).tolist():
        words = lines[doc].split(" ")
        for at in (places[docs == doc] - starts[doc]).tolist():
            found.add_word(f" {' '.join(words[at : at + PHRASE])} ", 0)
    found.make_automaton()
    return found


def _locate(found: ahocorasick.Automaton, line: str, n: int) -> np.ndarray:
    """Whether a phrase of the automaton starts at one of the first n words."""
    here = np.zeros(n, bool)
    ends = np.fromiter((end for end, _ in found.iter(f" {line} ")), np.int64) if len(found) else here[:0]
    if len(ends):
        here[np.searchsorted(_word_ends(line), ends) - PHRASE + 1] = True
    return here


def _name_windows(width: int, parts: int):
    def run(block: pd.DataFrame, named: pd.DataFrame) -> pd.DataFrame:
        if not len(named) or not len(block):
            return _packed(0, *[np.zeros(0, np.int64)] * 3)
        texts, keys, others, ids = Texts(block, width), [], [], []
        grams = texts.grams(PHRASE)
        found = _automaton(texts.lines, grams, np.unique(_unpacked(named, np.uint64)[1]))
        for doc, line, h, gram in zip(texts.ids, texts.lines, texts.hashed, grams, strict=True):
            here = _locate(found, line, len(gram))
            if not here.any():
                continue
            least = sliding_min(gram, width - PHRASE + 1)
            located = sliding_min(np.where(here, gram, np.iinfo(np.uint64).max), width - PHRASE + 1) == least
            keys.append(gram_hashes(h, width)[located]), others.append(gram_hashes(h, width, _BASES[1])[located])
            ids.append(np.full(int(located.sum()), doc))
        keys, others, ids = _joined(keys, np.uint64), _joined(others, np.uint64), _joined(ids, np.int64)
        order, starts = _groups(keys)
        least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids
        first = order[starts]
        return _packed(block["block"].iloc[0], others[first] % np.uint64(parts), keys[first], least)

    return run


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each key starts in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else order


def _least_of(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each entry the smallest identifier among those with its key."""
    order, starts = _groups(keys)
    out = ids.copy()
    if len(starts):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(keys))))
    return out


def _earlier(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block, its windows that a smaller identifier has elsewhere, with that one."""
    blocks, keys, ids = _unpacked(rows, np.uint64, np.int64)
    first = _least_of(keys, ids)
    mine = first < ids
    blocks, keys, first = blocks[mine], keys[mine], first[mine]
    order = np.argsort(blocks, kind="stable")
    names, starts = np.unique(blocks[order], return_index=True)
    cut = (np.split(x[order], starts[1:]) if len(starts) else [] for x in (keys, first))
    return pd.DataFrame({"part": np.zeros(len(names), np.int64), "block": names.astype(np.int64)} | {f"c{i}": [x.tobytes() for x in c] for i, c in enumerate(cut)})


def _remove(width: int):
    def run(block: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        hashes, lines, counts, windows = WordHashes(), [], [], []
        own = block["doc_id"].to_numpy(np.int64)
        for text in block["text"]:
            words = words_of(text)
            lines.append(" ".join(words).encode()), counts.append(len(words))
            windows.append(gram_hashes(hashes(words), width) if len(words) >= width else np.zeros(0, np.uint64))
        n = np.array([len(w) for w in windows])
        ids = np.repeat(own, n)
        keys, least = _joined(windows, np.uint64), ids
        if len(elsewhere):
            _, more, first = _unpacked(elsewhere, np.uint64, np.int64)
            keys, least = np.concatenate([keys, more]), np.concatenate([least, first])
        twice = _least_of(keys, least)[: len(ids)] < ids
        ends, out = np.cumsum(n), []
        for doc, line, count, start, end in zip(own.tolist(), lines, counts, (ends - n).tolist(), ends.tolist(), strict=True):
            starts, removed = np.flatnonzero(twice[start:end]), 0
            if len(starts):
                edge = np.zeros(count + 1, np.int64)
                edge[starts] += 1
                edge[starts + width] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed = int(gone.sum())
                line = b" ".join(w for w, g in zip(line.split(b" "), gone.tolist(), strict=True) if not g)
            out.append((doc, count, removed, hashlib.sha256(line).hexdigest()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def remove_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``width`` words over it also starts in a row with a smaller
    identifier; rows of the same identifier don't remove each other's words. Null text has
    no words. A row without an identifier comes after all others. No rows in: no rows out.
    Other columns are not read.
    """
    if width <= PHRASE:
        raise ValueError(f"width is at least {PHRASE + 1}")
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(math.ceil(size / block_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    # as many partitions as blocks: what a task reads stays at a few blocks, whatever the corpus
    blocks = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))).repartition(n, "block")
    packed = "part long, block long, c0 binary"
    named = blocks.groupBy("block").applyInPandas(_name_phrases(width, n), packed)
    several = named.groupBy("part").applyInPandas(_recurring, packed)
    windows = blocks.groupBy("block").cogroup(several.groupBy("block")).applyInPandas(_name_windows(width, n), packed + ", c1 binary")
    earlier = windows.groupBy("part").applyInPandas(_earlier, packed + ", c1 binary")
    out = blocks.groupBy("block").cogroup(earlier.groupBy("block")).applyInPandas(_remove(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_LAST)))


@query
def op1_passages(spark, sf_dir):
    return remove_passages(table(spark, sf_dir, "documents"))
