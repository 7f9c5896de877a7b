"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of itself plus the mean of embeddings of its character
sequences. Two gated recurrent layers read a window of words from both ends, attention pools
their states, and a document's score is that of its highest window; windows overlap by half
and cover the whole text. It is trained here on a bounded sample of labelled documents: in
every pass each document is represented by the window that scores highest at that time, as
the label says only that some window is toxic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import query, table
from lakecheck.llm.sampling import hash_sample
from lakecheck.llm.words import words_of

WINDOW, STRIDE = 64, 32
#: Labelled documents for training, toxic and others, at most, chosen by a hash of the number;
#: and windows of one of these, chosen at random over the whole text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1024, 2048, 10
WORD_ROWS, CHAR_ROWS, WIDTH, HIDDEN = 8192, 16384, 12, 12
STEPS, BATCH, RATE = 500, 32, 0.01
MOST_WORDS = 200_000
_STRIP = ".,;:!?|#$%&*\"'()"


def _line_of(word: str) -> bytes:
    """The word as it is embedded, between two marks."""
    return f"^{word.strip(_STRIP).lower() or word.lower()}$".encode()


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (rows >> np.uint32(1))
    return rows


_CRC = _crc_table()


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """CRC-32 states after one more byte each."""
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def _grams_of(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of the character sequences of all words, and where each word's end: all
    of three bytes, and the word's first four to seven. Rows are CRC-32 of the sequences."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    text = np.frombuffer(b"".join(lines), np.uint8).astype(np.uint32)
    first = np.cumsum(n) - n
    state = np.full(max(len(text) - 2, 0), 0xFFFFFFFF, np.uint32)
    for k in range(3):
        state = _crc_step(state, text[k : len(state) + k])
    threes = n - 2  # a line has a byte between its marks at least
    ends = np.cumsum(threes + np.minimum(n, 7) - 3)
    begins = ends - (threes + np.minimum(n, 7) - 3)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint32)
    inside = np.arange(threes.sum()) - np.repeat(np.cumsum(threes) - threes, threes)
    out[inside + np.repeat(begins, threes)] = state[inside + np.repeat(first, threes)]
    long, so_far = np.arange(len(n)), state[first]
    for k in range(4, 8):
        some = n[long] >= k
        long = long[some]
        so_far = _crc_step(so_far[some], text[first[long] + k - 1])
        out[begins[long] + threes[long] + k - 4] = so_far
    return ((out ^ np.uint32(0xFFFFFFFF)) % CHAR_ROWS).astype(np.int64), ends


def starts_of(n: int) -> range:
    """First words of the windows over n words."""
    return range(0, max(n - STRIDE, 1), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Words:
    """Inputs of distinct words, row 0 being no word."""

    own: np.ndarray
    grams: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Words:
        lines = [_line_of(w) for w in words]
        return cls(np.fromiter(map(zlib.crc32, lines), np.int64, len(lines)) % WORD_ROWS, *_grams_of(lines))

    def embedded(self, net: dict) -> np.ndarray:
        if not len(self.own):
            return np.zeros((0, WIDTH), np.float32)
        starts = np.concatenate([[0], self.ends[:-1]])
        mean = np.add.reduceat(net["chars"][self.grams], starts) / np.diff(np.append(starts, self.ends[-1]))[:, None]
        return (net["words"][self.own] + mean).astype(np.float32)

    def spread(self, d: np.ndarray, grad: dict) -> None:
        np.add.at(grad["words"], self.own, d)
        n = np.diff(np.concatenate([[0], self.ends]))
        np.add.at(grad["chars"], self.grams, np.repeat(d / n[:, None], n, axis=0))


def new_net(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"words": (WORD_ROWS, WIDTH), "chars": (CHAR_ROWS, WIDTH), "in": (2, WIDTH, 3 * HIDDEN), "back": (2, HIDDEN, 3 * HIDDEN),
              "bias": (2, 1, 3 * HIDDEN), "look": (2 * HIDDEN, HIDDEN), "key": (HIDDEN,), "out": (2 * HIDDEN,), "shift": (1,)}
    scale = {"words": 0.1, "chars": 0.3, "bias": 0.0, "shift": 0.0}
    return {k: (rng.normal(size=s) * scale.get(k, 0.3)).astype(np.float32) for k, s in shapes.items()}


def projected(net: dict, x: np.ndarray) -> np.ndarray:
    """Both directions' inputs to the gates: 2 x words x 3 gates."""
    return x @ net["in"] + net["bias"]


def forward(net: dict, inputs: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows; ``at``: windows x WINDOW rows of ``inputs``, row 0 past the end.
    ``keep`` gets what :func:`backward` needs."""
    n, steps = at.shape
    real = (at > 0).astype(np.float32)
    h = np.zeros((2, n, HIDDEN), np.float32)
    states = np.empty((steps, n, 2 * HIDDEN), np.float32)
    order = (range(steps), range(steps - 1, -1, -1))
    for t in range(steps):
        t2 = order[0][t], order[1][t]
        x = np.stack([inputs[0][at[:, t2[0]]], inputs[1][at[:, t2[1]]]])
        mask = np.stack([real[:, t2[0]], real[:, t2[1]]])[:, :, None]
        u = h @ net["back"]
        zr = _sigmoid(x[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
        z, r = zr[..., :HIDDEN], zr[..., HIDDEN:]
        new = np.tanh(x[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
        before, h = h, h + mask * (1 - z) * (new - h)
        states[t2[0], :, :HIDDEN], states[t2[1], :, HIDDEN:] = h[0], h[1]
        if keep is not None:
            keep.append((t2, mask, z, r, new, u[..., 2 * HIDDEN :], before))
    seen = np.tanh(states @ net["look"])
    score = np.where(real.T > 0, seen @ net["key"], -1e9)
    weight = np.exp(score - score.max(axis=0)) * real.T
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep.append((states, seen, weight, pooled))
    return pooled @ net["out"] + net["shift"]


def backward(net: dict, words: Words, x: np.ndarray, at: np.ndarray, keep: list, d: np.ndarray) -> dict:
    """Gradients for the logits' gradients ``d``."""
    grad = {k: np.zeros_like(v) for k, v in net.items() if k not in ("scale", "offset")}
    states, seen, weight, pooled = keep.pop()
    grad["shift"][0], grad["out"] = d.sum(), d @ pooled
    d_pool = d[:, None] * net["out"]
    d_states = weight[:, :, None] * d_pool
    d_weight = (states * d_pool).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grad["key"] = np.einsum("tn,tnh->h", d_score, seen)
    d_look = d_score[:, :, None] * net["key"] * (1 - seen**2)
    grad["look"] = np.einsum("tni,tnh->ih", states, d_look, optimize=True)
    d_states += d_look @ net["look"].T
    d_in = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
    dh = np.zeros_like(keep[0][-1])
    for (t0, t1), mask, z, r, new, un, before in reversed(keep):
        dh = dh + np.stack([d_states[t0, :, :HIDDEN], d_states[t1, :, HIDDEN:]])
        step = dh * mask
        d_new = step * (1 - z) * (1 - new**2)
        d_z = step * (before - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], axis=2)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=2)
        grad["back"] += before.transpose(0, 2, 1) @ d_u
        for way, t in enumerate((t0, t1)):
            np.add.at(d_in[way], at[:, t], d_x[way])
        dh = dh * (1 - mask) + step * z + d_u @ net["back"].transpose(0, 2, 1)
    d_in[:, 0] = 0
    grad["bias"] = d_in.sum(axis=1, keepdims=True)
    grad["in"] = x.T @ d_in
    words.spread((d_in @ net["in"].transpose(0, 2, 1)).sum(axis=0)[1:], grad)
    return grad


def fit(windows: list[str], doc: np.ndarray, toxic: np.ndarray, steps: int = STEPS, seed: int = 5) -> dict[str, np.ndarray]:
    """A net from windows (words joined by spaces), the document of each and the label of each
    document; with ``scale`` and ``offset`` that turn a document's highest logit into a chance."""
    net = new_net(seed) | {"scale": np.ones(1), "offset": np.zeros(1)}
    if not len(windows) or not 0 < toxic.sum() < len(toxic):
        net["offset"][0] = 3.0 if len(toxic) and toxic.all() else -3.0
        return net | {"scale": np.zeros(1)}
    index: dict[str, int] = {}
    at = np.zeros((len(windows), WINDOW), np.int64)
    for row, text in zip(at, windows, strict=True):
        ids = [index.setdefault(w, len(index) + 1) for w in text.split(" ") if w]
        row[: len(ids)] = ids
    every = list(index)
    words = Words.of(every)
    trained = [k for k in net if k not in ("scale", "offset")]
    m, v, step = {k: np.zeros_like(net[k]) for k in trained}, {k: np.zeros_like(net[k]) for k in trained}, 0
    rng = np.random.default_rng(seed)
    balance = np.where(toxic > 0, (toxic == 0).sum() / toxic.sum(), 1.0) ** 0.5

    def logits() -> np.ndarray:
        inputs = projected(net, np.concatenate([np.zeros((1, WIDTH), np.float32), words.embedded(net)]))
        return np.concatenate([forward(net, inputs, at[i : i + 1024]) for i in range(0, len(at), 1024)])

    def highest(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, doc))
        return order[np.append(np.flatnonzero(doc[order][1:] != doc[order][:-1]), len(order) - 1)]

    epochs = max(3, -(-steps * BATCH // len(toxic)))
    top = highest(rng.random(len(at)))
    for epoch in range(epochs):
        if epoch > 1:
            top = highest(logits()) if epoch % 2 == 0 else top
        elif epoch:
            top = highest(rng.random(len(at)))
        rate = RATE * (1 - epoch / epochs) + 1e-3
        mine = rng.permutation(top)
        for i in range(0, len(mine), BATCH):
            part = mine[i : i + BATCH]
            used, local = np.unique(np.append(at[part].ravel(), 0), return_inverse=True)
            few = Words.of([every[u - 1] for u in used[1:]])
            x = np.concatenate([np.zeros((1, WIDTH), np.float32), few.embedded(net)])
            keep: list = []
            out = forward(net, projected(net, x), local[:-1].reshape(len(part), WINDOW), keep)
            y = toxic[doc[part]]
            d = ((_sigmoid(out) - y) * balance[doc[part]] / len(part)).astype(np.float32)
            grad = backward(net, few, x, local[:-1].reshape(len(part), WINDOW), keep, d)
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            for k, g in grad.items():
                g = g / max(1.0, norm)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    value = logits()
    best = highest(value)
    x, y = value[best], toxic[doc[best]]
    a, b = 1.0, 0.0
    for _ in range(200):  # two numbers, by gradient steps of the log loss
        error = _sigmoid(a * x + b) - y
        a, b = max(a - 0.1 * float((error * x).mean()), 0.05), b - 0.1 * float(error.mean())
    return net | {"scale": np.array([a]), "offset": np.array([b])}


class Scorer:
    """Scores whole texts; what the gates get from a word is kept for the next texts."""

    def __init__(self, net: dict):
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.inputs = projected(self.net, np.zeros((1, WIDTH), np.float32))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > MOST_WORDS:
            self.forget()
        cut = [words_of(t) for t in texts]
        new = list(set().union(*cut).difference(self.index))
        self.index.update(zip(new, range(len(self.index) + 1, len(self.index) + len(new) + 1), strict=True))
        self.inputs = np.concatenate([self.inputs, projected(self.net, Words.of(new).embedded(self.net))], axis=1)
        counts = [len(starts_of(len(c))) for c in cut]
        at = np.zeros((sum(counts), WINDOW), np.int64)
        row = 0
        for words in cut:
            ids = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            for start in starts_of(len(words)):
                part = ids[start : start + WINDOW]
                at[row, : len(part)] = part
                row += 1
        out = np.concatenate([forward(self.net, self.inputs, at[i : i + 1024]) for i in range(0, len(at), 1024)])
        high = np.maximum.reduceat(out, np.concatenate([[0], np.cumsum(counts)[:-1]]))
        return _sigmoid(self.net["scale"] * high + self.net["offset"]).astype(float)


def fold(doc_id) -> F.Column:
    """Rows with remainder 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
          toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, steps: int = STEPS) -> dict:
    """A net from labelled rows that are not held out. Rows without an identifier or a label
    are left out; with labels of one kind or none, all documents get one score. An identifier
    that repeats counts once: toxic if any of its labels says so, with the last of its texts."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna().where(fold(F.col("_id")) != 0)
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = [hash_sample(marked.where(F.col("_y") == y), ["_id"], n) for y, n in ((1, toxic), (0, clean))]
    few = chosen[0].union(chosen[1])  # bounds the broadcast

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                starts = np.array(starts_of(len(words)))
                pick = np.random.default_rng(doc & 0xFFFFFFFF).permutation(len(starts))[:SAMPLE_WINDOWS]
                out += [(doc, y, s, " ".join(words[s : s + WINDOW])) for s in starts[pick].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)], ["doc", "y", "start", "words"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.max("_text").alias("_text"))  # at most the sample's rows
    got = rows.mapInArrow(cut, "doc long, y int, start long, words string").toPandas()
    got = got.sort_values(["doc", "y", "start", "words"], ignore_index=True)  # the same net whatever the order of arrival
    names, doc = np.unique(got["doc"], return_inverse=True)
    label = np.zeros(len(names))
    np.maximum.at(label, doc, got["y"].to_numpy(float))
    return fit(got["words"].tolist(), doc, label, steps)


def score_toxicity(docs: DataFrame, net: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Null text is the empty text and is scored by what the net says about a window without
    words. A very long text is cut into windows in its task; its score is that of the highest, as
    ever. A null identifier is not held out. Repeated rows get the same score. No rows in: no rows
    out. Nothing but the text is an input of the score; other columns, whatever their names, are
    not read.
    """
    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(net)
        for texts in parts:
            scores = [scorer(texts.iloc[i : i + 256].tolist()) for i in range(0, len(texts), 256)]
            yield pd.Series(np.concatenate(scores) if scores else np.zeros(0))

    scored = docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("score"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
