"""Quality rules: gradient-boosted trees over statistics of a document.

The trees are grown here, on a bounded sample of labelled documents, with monotonic
constraints on chosen statistics. They are complete binary trees of a fixed depth, laid side
by side in arrays, so a batch goes down all of them in ``depth`` steps without a loop over
rows or trees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import query, table
from lakecheck.llm.sampling import hash_sample

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Labelled documents the trees are grown on, at most; chosen by a hash of their number.
SAMPLE_ROWS = 8192
#: Rejected if the chance of good quality is below.
LEAST_CHANCE = 0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics of the trees; more of one with -1 never makes a document look better.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines_share": -1, "repeat_share": -1,
    "distinct_share": 0, "upper_share": -1, "digit_share": -1, "mark_share": 0, "shout_share": -1, "words_per_line": 0, "longest_word": 0,
}
_UPPER, _DIGIT, _MARK = (np.array([f(chr(b)) for b in range(256)]) for f in (
    lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in ".,;:!?\"'()-"))
_SHOUT = re.compile(rb"!!|\?\?|[A-Z]{4,}")


def repeated(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)[1]
    _, at, n = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(twice)] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> list[float]:
    """The base counts and then the statistics, of a whole text; null is the empty text."""
    data = (text or "").encode()
    words = data.split()
    n, chars = len(words), len(text or "") - (len(data) - len(data.translate(None, SPACE)))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    dup, again = len(lines) - len(set(lines)), repeated(words)
    each, some = np.bincount(np.frombuffer(data, np.uint8), minlength=256), max(n, 1)
    return [
        n, chars, symbols, dup, again,
        np.log1p(n), chars / some, symbols / some, dup / max(len(lines), 1), again / some, len(set(words)) / some,
        each[_UPPER].sum() / some, each[_DIGIT].sum() / some, each[_MARK].sum() / some, len(_SHOUT.findall(data)) / some,
        n / max(len(lines), 1), max(map(len, words), default=0),
    ]


@dataclass(frozen=True)
class Trees:
    """``feature, cut``: trees x inner nodes, in level order; ``value``: trees x leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float

    def chance(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        inner, rows = self.feature.shape[1], np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return 1 / (1 + np.exp(-self.start - self.value[trees, node - inner].sum(axis=1)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], n_trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 1.0, smooth: float = 1.0) -> Trees:
    """Newton boosting of the log loss over histograms.

    A split on a constrained statistic must order its sides, and the middle of their values
    bounds whatever grows below: left and right can't cross.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    share = np.clip(y.mean() if len(y) else 1.0, 0.02, 0.98)
    start = float(np.log(share / (1 - share)))
    out = np.full(len(y), start)
    inner = 2**depth - 1
    features, cuts, values = [], [], []
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        node = np.zeros(len(y), np.int64)
        limits = {0: (-np.inf, np.inf)}
        for k in range(inner):
            low, high = limits[k]
            limits[2 * k + 1] = limits[2 * k + 2] = (low, high)
            mine = np.flatnonzero(node == k)
            best = (1e-6, 0, 0, 0.0)
            for f, sign in enumerate(signs):
                gs, hs = (np.bincount(binned[mine, f], w[mine], len(edges[f]) + 1).cumsum() for w in (g, h))
                gl, hl = gs[:-1], hs[:-1]
                gr, hr = gs[-1] - gl, hs[-1] - hl
                wl, wr = (np.clip(a / (b + smooth), low, high) for a, b in ((gl, hl), (gr, hr)))
                whole = np.clip(gs[-1] / (hs[-1] + smooth), low, high)
                gain = sum(a * w - (b + smooth) * w * w / 2 for a, b, w in ((gl, hl, wl), (gr, hr, wr))) - (gs[-1] * whole - (hs[-1] + smooth) * whole**2 / 2)
                gain[(hl < least) | (hr < least) | (sign * (wr - wl) < 0)] = -np.inf
                at = int(gain.argmax()) if len(gain) else 0
                if len(gain) and gain[at] > best[0]:
                    best = (gain[at], f, at, (wl[at] + wr[at]) / 2)
            if best[0] > 1e-6:
                _, f, at, middle = best
                feature[k], cut[k] = f, edges[f][at]
                if signs[f]:
                    limits[2 * k + 1], limits[2 * k + 2] = ((low, middle), (middle, high))[:: signs[f]]
            node[mine] = 2 * k + 1 + (x[mine, feature[k]] > cut[k])
        for leaf in range(inner + 1):
            mine = node == inner + leaf
            value[leaf] = rate * np.clip(g[mine].sum() / (h[mine].sum() + smooth), *limits[inner + leaf])
        out += value[node - inner]
        features.append(feature), cuts.append(cut), values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), start)


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most ``sample_rows`` labelled documents; without any, nothing is rejected
    beyond the base rules. Rows without an identifier or a label are left out. An
    identifier that repeats counts once: with its highest label and the last of its texts."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).dropna()
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = hash_sample(marked, ["_id", "_y"], sample_rows)  # bounds the broadcast

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_y").agg(F.max("_text").alias("_text"))  # at most sample_rows
    got = rows.select("_y", stats("_text").alias("x")).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(BASE) + len(FEATURES))[:, len(BASE) :]
    order = np.lexsort((*x.T, got["_y"]))  # the same trees whatever the order of arrival
    return grow(x[order], got["_y"].to_numpy(float)[order], list(FEATURES.values()))


def judge(model: Trees, least_chance: float = LEAST_CHANCE):
    """A column function: text -> base counts, ``base_failed``, ``chance`` and ``kept``."""

    @F.pandas_udf(", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, chance double, kept boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        x = np.array([statistics(t) for t in texts], float).reshape(len(texts), len(BASE) + len(FEATURES))
        out = pd.DataFrame(x[:, : len(BASE)].astype(np.int64), columns=BASE)
        out["base_failed"] = (out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words)
        out["chance"] = model.chance(x[:, len(BASE) :])
        out["kept"] = ~out.base_failed & (out.chance >= least_chance)
        return out

    return run


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the base counts, ``base_failed, chance, kept``.

    Null text is the empty text and fails the base rule, as all texts under 50 words. Null
    identifiers and repeated rows are judged like others; a very long text is one row's work in
    its task. No rows in: no rows out. Other columns, whatever their names, are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), judge(model)(F.col(text_col)).alias("q")).select("doc_id", "q.*")


def drop_poor(docs: DataFrame, model: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    return docs.where(judge(model)(F.col(f"`{text_col}`"))["kept"])


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
