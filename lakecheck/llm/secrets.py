"""Secret scans: a random forest removes false findings among secret-like strings.

A candidate is a run of 12 or more letters, digits and ``+/_-`` with a digit in it, and the
value of every match of a known key format, with or without a digit. The forest
sees its length, how its characters change class, how much of it a dictionary of the corpus
covers, what looks like a path in and around it, and the words next to it. It is grown here
from labelled findings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import query, table
from lakecheck.llm.sampling import hash_sample
from lakecheck.session import materialize

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{12,}")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(rb"[a-z]{3,16}")
#: The most frequent words of all documents, and labelled findings for training, at most.
DICTIONARY_WORDS, SAMPLE_FINDINGS = 4096, 8192
NEIGHBOURS, AROUND = 16, 48
N_TREES, DEPTH, BINS, LEAST_CHANCE = 40, 5, 32, 0.5

# Key formats of the findings that a corpus without labels is labelled by. What
# follows the name of a key, and the bodies of keys, are values of 12 characters or more.
KEY_FORMATS = (
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_[A-Za-z0-9_]{20,}|\bglpat-[A-Za-z0-9_\-]{20,}|\bxox[abeoprs]-[A-Za-z0-9\-]{10,}|\bAIza[A-Za-z0-9_\-]{35}"
    r"|\b[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|\bsk-[A-Za-z0-9_\-]{20,}|\bnpm_[A-Za-z0-9]{30,}|\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{12,}|(?i:bearer\s+|(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)[A-Za-z0-9+/_\-]{12,}"
)
#: Judged false without labels: dates, numbers, identifiers in hex groups, parts of addresses.
KNOWN_FALSE = r"(?:19|20)\d\d[-/_]\d\d[-/_]\d\d[-/_\dTZ]*|[\d\-_/+]+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|/?(?:[a-z]+\d{0,4}[/_\-])+[a-z]*\d{0,4}/?|[a-z]+\d{1,4}"
#: Judged false inside a key format: placeholders, keys of documentation, runs of few characters.
PLACEHOLDER = r"(?i:.*(?:example|sample|placeholder|changeme|change_me|dummy|redacted|your[_-]|my[_-](?:secret|token|key)|xxxx|\*\*\*\*).*)"
LEAST_CHARACTERS = 5
_KEY, _FALSE = re.compile(KEY_FORMATS), re.compile(KNOWN_FALSE)
_PLACEHOLDER = re.compile(PLACEHOLDER)
_NAMED = re.compile(r"(?:bearer\s+|(?:password|passwd|secret|token|api_?key)\s*[=:]\s*[\"']?)", re.IGNORECASE)
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Every match of KEY_FORMATS has one of these, the latter ones after case folding.
_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xox", "AIza", "k_live_", "k_test_", "sk-", "npm_", "eyJ", "-----BEGIN ")
_NAME_HINTS = ("bearer", "passw", "secret", "token", "key")


def _values(text: str) -> list[tuple[int, int]]:
    """Start and end of the value of every key, without the name before it."""
    out, folded = [], text.casefold()
    if not (any(h in text for h in _HINTS) or any(h in folded for h in _NAME_HINTS)):
        return out
    for m in _KEY.finditer(text):
        named = _NAMED.match(m[0]) or _PEM.match(m[0])
        out.append((m.start() + (named.end() if named else 0), m.end()))
    return out


def _label(value: str) -> int:
    """1 for the value of a key, 0 if it only stands in for one."""
    return 0 if _PLACEHOLDER.fullmatch(value) or len(set(value)) < LEAST_CHARACTERS else 1


def _judged(text: str) -> list[tuple[int, int, int]]:
    """Candidates with 1 for a key format, 0 for a known false form or a stand-in inside a key
    format, -1 for neither."""
    keys, out = _values(text), []
    runs, k = [m.span() for m in _RUN.finditer(text)], 0
    met = set()
    for start, end in runs:
        while k < len(keys) and keys[k][1] <= start:
            k += 1
        inside = range(k, next((j for j in range(k, len(keys)) if keys[j][0] >= end), len(keys)))
        met.update(inside)
        if inside or _DIGIT.search(text, start, end):
            out.append((start, end, _label(text[start:end]) if inside else 0 if _FALSE.fullmatch(text, start, end) else -1))
    # keys all of whose runs are shorter than a candidate
    out += [(*span, _label(text[slice(*span)])) for at, span in enumerate(keys) if at not in met]
    return sorted(out)


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Start and end, in characters, of every candidate of a whole text; null: none."""
    return [(start, end) for start, end, _ in _judged(text or "")]


def features(text: str, start: int, end: int, known: set[str]) -> list[float]:
    """What the forest sees of the candidate ``text[start:end]``."""
    found, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in found]
    n, moves, each = len(found), Counter(zip(kinds, kinds[1:], strict=False)), Counter(found)
    letters = re.findall("[a-z]+", found.lower())
    covered = 0
    for run in letters:
        at = 0
        while at < len(run):  # longest word first
            size = next((s for s in range(min(16, len(run) - at), 2, -1) if run[at : at + s] in known), 0)
            covered += size
            at += size or 1
    words = (re.findall(r"\w+", before)[-1:] or [""])[0].lower(), (re.findall(r"\w+", after)[:1] or [""])[0].lower()
    near = [0.0] * (2 * NEIGHBOURS)
    for side, word in enumerate(words):
        near[side * NEIGHBOURS + zlib.crc32(word.encode()) % NEIGHBOURS] = 1.0
    return [
        n, sum(k == "d" for k in kinds) / n, sum(k == "u" for k in kinds) / n, -sum(c / n * np.log2(c / n) for c in each.values()),
        *(moves[a, b] / (n - 1) for a in "dul" for b in "dul"), sum(len(x) for x in letters) / n, covered / n,
        found.count("/"), found.count("_") + found.count("-"), before[-1:] in ("/", ".", "\\"), after[:1] in ("/", ".", "\\"),
        "=" in before[-3:] or ":" in before[-3:], before[-1:] in "\"'" and before != "", words[0] in known, words[1] in known, *near,
    ]


N_FEATURES = len(features("x" * 12, 0, 12, set()))


@dataclass(frozen=True)
class Forest:
    """Complete trees in level order: ``feature, cut`` of inner nodes, ``share`` of leaves."""

    feature: np.ndarray
    cut: np.ndarray
    share: np.ndarray

    def chance(self, x: np.ndarray) -> np.ndarray:
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node, inner = np.zeros((len(x), len(trees)), np.int64), self.feature.shape[1]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.share[trees, node - inner].mean(axis=1)


def grow_forest(x: np.ndarray, y: np.ndarray, n_trees: int = N_TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
    """Trees on bootstrap samples; every split looks at a random square root of the features.
    A leaf's share counts one finding of each kind more than it has."""
    rng, inner = np.random.default_rng(seed), 2**depth - 1
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    feature, cut, share = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf), np.full((n_trees, inner + 1), 0.5)
    for tree in range(n_trees):
        mine = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, np.int64)
        node = np.zeros(len(mine), np.int64)
        for k in range(inner):
            rows = mine[node == k]
            best = 0.0
            for f in rng.choice(x.shape[1], int(np.sqrt(x.shape[1])) + 1, replace=False) if len(rows) > 1 else ():
                right = x[rows, f][:, None] > edges[f]
                n_right, ones = right.sum(axis=0), (right * y[rows][:, None]).sum(axis=0)
                n_left, left_ones = len(rows) - n_right, y[rows].sum() - ones
                purity = ones**2 / np.maximum(n_right, 1) + left_ones**2 / np.maximum(n_left, 1) - y[rows].sum() ** 2 / len(rows)
                purity[(n_right == 0) | (n_left == 0)] = 0
                if purity.max(initial=0) > best + 1e-12:
                    best, feature[tree, k], cut[tree, k] = purity.max(), f, edges[f][purity.argmax()]
            at = node == k
            node[at] = 2 * k + 1 + (x[rows, feature[tree, k]] > cut[tree, k])
        for leaf in range(inner + 1):
            inside = y[mine[node == inner + leaf]]
            share[tree, leaf] = (inside.sum() + 1) / (len(inside) + 2)
    return Forest(feature, cut, share)


def dictionary(docs: DataFrame, text_col: str = "text", words: int = DICTIONARY_WORDS) -> set[str]:
    """The words that occur most often in all documents; of those with equal counts the first
    by name."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update(_WORD.findall(text or b""))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("size", F.floor(F.log2("n")).cast("int")), "word-counts")
    # words by the power of two of their count: those below the power that completes the dictionary stay where they are
    above, least = 0, 0
    for r in counts.groupBy("size").count().orderBy(F.desc("size")).collect():  # at most 63 rows
        above, least = above + r["count"], r["size"]
        if above >= words:
            break
    some = counts.where(F.col("size") >= least)
    if above > 8 * words:  # very many with counts alike: by their exact count
        seen, low = 0, 0
        for r in some.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
            seen, low = seen + r["count"], r["n"]
            if seen >= words:
                break
        some = some.where(F.col("n") >= low)
    # what is left is sorted by tasks; only the dictionary itself comes to the driver
    ranked = some.repartitionByRange(8, F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    return {r["word"] for r in ranked.limit(words).collect()}


_FOUND = "doc_id long, start long, length long, label int, chance double"


def _found(known: set[str], forest: Forest | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, x = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for start, end, label in _judged(text):
                    out.append((doc, start, end - start, label))
                    x.append(features(text, start, end, known))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
            x = np.array(x, float).reshape(len(out), N_FEATURES)
            if forest is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "start", "length", "label", "x"])
            elif out:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(forest.chance(x))], ["doc_id", "start", "length", "label", "chance"])

    return run


def train(docs: DataFrame, known: set[str], findings: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE_FINDINGS) -> Forest:
    """A forest from at most half of ``sample`` findings of each label, chosen by a hash of their
    place, so that a rare label is there.

    ``findings``: ``doc_id, start, label`` of judged candidates. Without it, the candidates of
    known key formats count as secrets, those of KNOWN_FALSE, and stand-ins inside key formats
    (PLACEHOLDER, few different characters), as false; what is neither, or has no document
    identifier, is left out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    found = slim.mapInArrow(_found(known, None), "doc_id long, start long, length long, label int, x array<double>")
    if findings is not None:
        few = hash_sample(findings.select("doc_id", "start", F.col("label").cast("int").alias("label")).dropna(), ["doc_id", "start"], sample)
        found = found.drop("label").join(F.broadcast(few), ["doc_id", "start"])  # bounded by the sample
    else:
        found = found.where("label >= 0")
    told = materialize(found, "findings")
    each = [hash_sample(told.where(F.col("label") == y), ["doc_id", "start", "label"], sample // 2) for y in (0, 1)]
    rows = each[0].union(each[1]).toPandas().sort_values(["label", "doc_id", "start"], ignore_index=True)
    return grow_forest(np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES), rows["label"].to_numpy(float))


def scan(docs: DataFrame, known: set[str], forest: Forest, text_col: str = "text", id_col: str = "doc_id", least_chance: float = LEAST_CHANCE) -> DataFrame:
    """One row per candidate: ``doc_id, start, length, chance, secret``.

    ``start`` and ``length`` count characters, of a very long text as of any. Other columns are
    not read, whatever their names. Null and empty texts have no candidates. Null
    identifiers are kept, repeated rows repeat their candidates. No rows in: no rows out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    found = slim.mapInArrow(_found(known, forest), _FOUND)
    return found.select("doc_id", "start", "length", "chance", (F.col("chance") >= least_chance).alias("secret"))


@query
def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = dictionary(docs)
    return scan(docs, known, train(docs, known))
