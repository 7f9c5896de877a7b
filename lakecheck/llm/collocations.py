"""Collocations by dynamic itemset counting.

The corpus is cut into shards that are scanned in a cycle. All words are counted from the first
scan on; a longer phrase is activated once both its subphrases (without its last and without its
first word) have reached the threshold, in the scan after that, and is counted in as many scans
as there are shards: one full cycle, wherever it began, so its count is exact. Scans count
phrases of all lengths side by side, and end when the cycle of the last activation has.

What has reached the threshold is told to the tasks by an array of a fixed size: a phrase has a
few slots in it, and a slot holds the first scan for which it was marked. A phrase's subphrases
are ready in the latest scan of their slots. Slots that several phrases share may activate a
phrase early; it is then counted needlessly, but over a full cycle like any other. So the array
needs no candidate list, whose size grows with the corpus, and bounds neither phrases nor counts.

Tasks count in numpy and give a row per distinct phrase and chunk of words; Spark sums them. The
state of phrases whose cycle runs is a written table.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.llm.registry import ORACLES, query, table
from lakecheck.session import fits_broadcast, materialize

THRESHOLD, LONGEST, SHARDS, TOP = 10, 3, 2, 2000
#: Slots of the array that tells what is frequent: one byte each, whatever the corpus.
SLOTS = 1 << 24
#: Text bytes that a task counts at once; a longer text is counted alone.
CHUNK_BYTES = 4 << 20
#: Groups that a language's phrases are dealt to before its first ones are taken from theirs.
DEALT = 64
UNKNOWN = "und"
NEVER = 255

_BREAKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_COUNTS = "key string, n long"
_FIRST = 48  # character of scan 0 at the start of a key


# --- hashes that all tasks share ----------------------------------------------------------


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\x00" + word, 11)


def _longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and a word behind it."""
    with np.errstate(over="ignore"):
        x = hashes * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slots(hashes: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(n_slots)).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(n_slots)).astype(np.int64)


def _ready(hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The first scan in which phrases with this subphrase may be counted."""
    a, b = _slots(hashes, len(marks))
    return np.maximum(marks[a], marks[b])


# --- one scan -----------------------------------------------------------------------------


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Words of some texts as numbers from 1, 0 between pieces and behind the last one, and the
    words by number. Whole texts side by side: no loop over words."""
    data = np.frombuffer(b"\n".join(texts).lower().translate(_BREAKS), np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    before = np.cumsum(data == 10, dtype=np.int32)[starts]
    fresh = np.diff(before, prepend=before[:1]) > 0  # a piece ends before the word
    out = np.zeros(n + int(fresh.sum()) + 1, np.int64)
    out[np.arange(n) + np.cumsum(fresh)] = words.indices.to_numpy() + 1
    return out, words.dictionary.cast(pa.large_string()).cast(pa.string())


class Chunk:
    """Some texts of a task, counted at once."""

    def __init__(self):
        self.texts: defaultdict[bytes, list[bytes]] = defaultdict(list)
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        self.texts[lang].append(text)
        self.size += len(text) + 1

    def counts(self, scan: int, shards: int, longest: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of the phrases that are active in this scan."""
        parts, own_words, own_langs, hashes, base = [], [pa.array([""])], [pa.array([""])], [np.zeros(1, np.uint64)], 0
        for lang, texts in self.texts.items():
            ids, known = numbered(texts)
            if scan < shards:
                yield _rows(pa.array([""]), pa.array([lang.decode()]), np.zeros(1, np.int64), np.array([np.count_nonzero(ids)]))
            parts.append(np.where(ids > 0, ids + base, 0))
            own_words.append(known)
            own_langs.append(pa.array([lang.decode()]).take(pa.array(np.zeros(len(known), np.int64))))
            hashes.append(np.fromiter((_word_hash(lang, w) for w in known.cast(pa.binary()).to_pylist()), np.uint64, len(known)))
            base += len(known)
        self.texts.clear()
        words, langs, hashed, n_words = pa.concat_arrays(own_words), pa.concat_arrays(own_langs), np.concatenate(hashes), base + 1
        x = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        if scan < shards:
            often = np.bincount(x, minlength=n_words)
            often[0] = 0
            own = np.flatnonzero(often)
            yield _rows(words.take(pa.array(own)), langs.take(pa.array(own)), np.zeros(len(own), np.int64), often[own])
        if scan == 0:  # nothing is marked yet
            return
        ready = _ready(hashed, marks)
        ready[0] = NEVER
        # at each place: hash of the phrase that begins there, and the scan that may count longer ones
        own_hash, own_ready = hashed[x], ready[x]
        for size in range(2, longest + 1):
            if len(own_ready) < 2:
                return
            since = np.maximum(own_ready[:-1], own_ready[1:])
            active = since <= scan  # both subphrases are ready, so no piece ends in it
            at = np.flatnonzero(active & (since + np.int64(shards) > scan))
            spelled, often = _distinct([x[at + i] for i in range(size)], n_words)
            if len(often):
                begun = _since(spelled, hashed, ready, marks)
                phrases = pc.binary_join_element_wise(*(words.take(pa.array(w)) for w in spelled), " ")
                yield _rows(phrases, langs.take(pa.array(spelled[0])), begun, often)
            if size < longest:
                at = np.flatnonzero(active)
                hashes, later = np.zeros(len(since), np.uint64), np.full(len(since), NEVER, np.uint8)
                hashes[at] = _longer(own_hash[at], hashed[x[at + size - 1]])
                later[at] = np.maximum(_ready(hashes[at], marks), since[at])
                own_hash, own_ready = hashes, later


def _distinct(columns: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of word numbers, and how often each occurs."""
    if n_words ** len(columns) < 1 << 63:
        keys = columns[0]
        for column in columns[1:]:
            keys = keys * n_words + column
        keys, often = np.unique(keys, return_counts=True)
        out = []
        for _ in columns:
            keys, last = np.divmod(keys, n_words)
            out.append(last)
        return out[::-1], often
    rows, often = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return list(rows.T), often


def _since(spelled: list[np.ndarray], hashed: np.ndarray, ready: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The scan in which a phrase's cycle began, the same in every scan that counts it."""
    hashes, levels = [hashed[w] for w in spelled], [ready[w] for w in spelled]
    for size in range(2, len(spelled) + 1):
        since = [np.maximum(a, b) for a, b in zip(levels, levels[1:])]
        hashes = [_longer(h, hashed[w]) for h, w in zip(hashes, spelled[size - 1 :])]
        levels = since if size == len(spelled) else [np.maximum(_ready(h, marks), s) for h, s in zip(hashes, since)]
    return levels[0].astype(np.int64)


def _rows(phrases: pa.Array, langs: pa.Array, since: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A key is the scan in which a phrase's cycle began, the phrase and, behind a line end,
    which no phrase has in it, the language."""
    begun = pa.array([chr(_FIRST + i) for i in range(int(since.max(initial=0)) + 1)]).take(pa.array(since))
    key = pc.binary_join_element_wise(pc.binary_join_element_wise(begun, phrases, ""), langs, "\n")
    return pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64())], ["key", "n"])


def _scan(scan: int, shards: int, longest: int, packed, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        chunk = Chunk()
        for batch in batches:
            for lang, text in zip(*(c.cast(pa.binary()).to_pylist() for c in batch.columns), strict=True):
                chunk.add(lang, text)
                if chunk.size >= chunk_bytes:
                    yield from chunk.counts(scan, shards, longest, marks)
                    chunk = Chunk()
        if chunk.size:
            yield from chunk.counts(scan, shards, longest, marks)

    return run


def _slots_of(n_slots: int):
    """Slots of phrases, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.zeros(batch.num_rows, np.uint64)
            for i, key in enumerate(batch.column(0).cast(pa.binary()).to_pylist()):
                phrase, lang = key.split(b"\n", 1)
                first, *rest = phrase[1:].split(b" ")
                h = np.array([_word_hash(lang, first)], np.uint64)
                for word in rest:
                    h = _longer(h, np.uint64(_word_hash(lang, word)))
                hashes[i] = h[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(hashes, n_slots)))], ["slot"])

    return run


def _mark(frequent: DataFrame, marks: np.ndarray, scan: int) -> bool:
    """Mark the slots of phrases that have reached the threshold (those of earlier ones keep
    their mark); whether any mark is new. What comes to the driver is a bit map of the slots,
    of a fixed size."""
    slots = frequent.select("key").mapInArrow(_slots_of(len(marks)), "slot long")
    bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    got = bits.toArrow()
    places, words, fresh = got["word"].to_numpy(), got["bits"].to_numpy(), False
    for bit in range(64):
        at = places[(words >> np.int64(bit)) & 1 == 1] * 64 + bit
        at = at[marks[at] == NEVER]
        marks[at] = scan
        fresh |= len(at) > 0
    return fresh


# --- the cycle ----------------------------------------------------------------------------


def frequent_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS,
    slots: int = SLOTS, chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``lang, phrase, size, n`` of all phrases of 1 to ``longest`` words with at least
    ``threshold`` occurrences, and for each language a row of size 0 with all its words.

    Texts are in lower case (A-Z) and split at ``.,;:!?`` and line ends; a phrase lies within a
    piece, its words between spaces and tabs. Every occurrence counts, overlapping ones too.
    Null text has no words, a null language is ``und``. Repeated rows count each time.
    """
    if not 2 <= slots or shards * longest >= NEVER:
        raise ValueError("shards * longest is less than 255")
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shard = F.pmod(F.xxhash64("text"), F.lit(shards))
    marks = np.full(slots, NEVER, np.uint8)
    phrase = F.expr("substring(substring_index(key, '\n', 1), 2)")
    size = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)
    running, done, scan, until = None, [], 0, shards
    while scan < until:
        packed = spark.sparkContext.broadcast(zlib.compress(marks.tobytes(), 1))
        counted = slim.where(shard == scan % shards).mapInArrow(_scan(scan, shards, longest, packed, chunk_bytes), _COUNTS)
        both = counted if running is None else running.unionByName(counted)
        summed = both.groupBy("key").agg(F.sum("n").alias("n"))
        over = F.ascii(F.substring("key", 1, 1)) - _FIRST + shards - 1 <= scan
        enough = (F.col("n") >= threshold) | (F.substring("key", 2, 1) == "\n")
        state = materialize(summed.select("key", "n", over.alias("over"), enough.alias("enough")).where("enough OR NOT over"), "phrases")
        done.append(state.where("over").select(F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), phrase.alias("phrase"), size.cast("int").alias("size"), "n"))
        running = state.where("NOT over").select("key", "n")
        scan += 1
        if _mark(state.where("enough").where(size.between(1, longest - 1)), marks, scan):
            until = scan + shards
        packed.unpersist()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# --- scores -------------------------------------------------------------------------------


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("_words", first, n), " ")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.join(F.broadcast(right) if fits_broadcast(right) else right, on, how)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, **scan: int
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases.

    A phrase of 2 to ``longest`` words that occurs ``a`` times, ``threshold`` or more, is cut in
    two after each of its words; with l and r occurrences of the parts a cut's score is
    ``floor(1000000 a a / (l r))``, computed exactly (decimals of 38 digits: up to a of 10^15). The
    lowest score counts, that of the shortest first part where several are lowest. A phrase goes if
    a longer one holds it and occurs at least half as often. Ranks go by score, a (both from
    the highest) and the phrase's bytes. See :func:`frequent_phrases` for nulls and words; no
    rows in, or none frequent: no rows out. Other columns are not read.
    """
    known = materialize(frequent_phrases(docs, text_col, lang_col, threshold, longest, shards, **scan), "frequent")
    parts = known.where(F.col("size").between(1, longest - 1))
    phrases = known.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("_words"))
    # phrases inside longer ones: each names those it holds, and the most frequent one counts
    inside = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("_words", i, n), " ")))))
    held = phrases.where("size > 2").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    own = phrases.join(held, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * 50))
    cuts = own.select("lang", "phrase", "a", "_words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_k"), "size").select(
        "lang", "phrase", "a", "_k", _part(1, F.col("_k")).alias("_first"), _part(F.col("_k") + 1, F.col("size") - F.col("_k")).alias("_rest"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        cuts = _joined(cuts, parts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    scored = cuts.withColumn("_up", (exact["a"] * exact["a"]).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)"))
    scored = scored.withColumn("_down", exact["l"] * exact["r"]).withColumn("score", F.expr("_up div _down"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    named = lowest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)).alias("_dealt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # the first of a language are among the first of each of its groups, so no task ranks all of it
    some = named.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_dealt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = known.where("size = 0").select("lang", "n")
    return _joined(ranked, totals, ["lang"]).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query
def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, words FROM (
        SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS words FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
            FROM documents))),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces),
grams AS (
    SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
    FROM places, (VALUES (1), (2), (3)) AS s(size) WHERE i + size - 1 <= len(words)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
held AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE size = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE size = 3) GROUP BY ALL),
own AS (
    SELECT c.* FROM candidates c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase AND c.size = 2
    WHERE longer IS NULL OR 100 * longer < 50 * c.a),
cuts AS (
    SELECT lang, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM own
    UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM own WHERE size = 3),
scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
