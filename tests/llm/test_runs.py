from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lakecheck.llm import runs

from .conftest import LONG, ROWS, SF, rows
from .test_dedup import WORD


def runs_brute(words, shortest=24, times=3):
    """Stretches of every period, each kept with its smallest one."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(shortest, times * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def row_brute(doc, words):
    found = runs_brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc, len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def planted_brute(doc, text):
    words = WORD.findall(text or "")
    n, h = len(words), None if doc is None else zlib.crc32(str(doc).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def texts():
    rng = random.Random(5)
    for n in range(300):
        letters, words = "abcdefgh"[: 1 + n % 8], []
        while len(words) < rng.randint(1, 250):
            if rng.random() < 0.6:
                unit = [rng.choice(letters) for _ in range(rng.randint(1, 30))]
                words += (unit * 12)[: rng.randint(1, 12 * len(unit))]
            else:
                words += [rng.choice(letters) for _ in range(rng.randint(1, 40))]
        yield words


def number(words):
    return np.unique(np.array(words), return_inverse=True)[1] if words else np.zeros(0, np.int64)


def test_runs_of_many_texts():
    with_runs = 0
    for words in texts():
        want = runs_brute(words)
        assert runs.runs_of(number(words)) == want
        with_runs += bool(want)
        assert runs.runs_of(number(words), 12, 4) == runs_brute(words, 12, 4)
    assert with_runs > 200


def test_repeats_without_a_run_stay_cheap():
    rng = random.Random(6)
    phrase = [f"p{i}" for i in range(30)]
    words = [w for i in range(3000) for w in [*phrase, f"{rng.random()}", f"x{i % 7}"]]
    assert runs.runs_of(number(words)) == []
    assert runs.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


@pytest.mark.parametrize("width", [1, 2, 15, 16, 17])
def test_repeating_texts(width):
    hashes = [runs.WordHashes()(w) for w in texts()] + [np.zeros(0, np.uint64)]
    want = [len({tuple(h[i : i + width]) for i in range(len(h) - width + 1)}) < max(len(h) - width + 1, 0) for h in map(np.ndarray.tolist, hashes)]
    assert runs._repeating(hashes, width).tolist() == want
    assert runs._repeating([np.zeros(0, np.uint64)], width).tolist() == [False]


def columns(df):
    return df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli")


def test_messy_rows(messy, nothing):
    want = [row_brute(i, [w for w in WORD.findall(t or "")]) for i, t, *_ in ROWS if t is not LONG]
    got = runs.find_runs(messy.where("doc_id IS NULL OR doc_id <> 6"))
    assert rows(columns(got)) == sorted((w[:6] for w in want), key=repr)
    long = runs.find_runs(messy.where("doc_id = 6")).collect()[0]
    assert [tuple(r) for r in long.runs][0] == (0, 40_000, 1) and long.start == 0 and long.n_words == 40_000 + 12_000
    assert long.kept.split()[:2] == ["word", "é漢"]
    assert rows(runs.find_runs(nothing)) == []


def test_words_with_one_hash(spark, monkeypatch):
    """Positions are numbered by hash only while no two words of a text share one."""
    monkeypatch.setattr(runs.WordHashes, "__call__", lambda self, words: np.array([len(w) for w in words], np.uint64))
    answer = next(runs._search(24, 3)(iter([runs.pa.RecordBatch.from_pydict({"d": [1], "t": [" ".join(f"{i % 10}" for i in range(90)) + " a" * 30]})])))
    assert [(r["start"], r["length"], r["period"]) for r in answer.to_pylist()[0]["runs"]] == [(0, 90, 10), (90, 30, 1)]


def test_query_against_brute_force(spark, documents):
    docs = [(r.doc_id, planted_brute(r.doc_id, r.text)) for r in documents.collect()]
    want = [row_brute(i, w) for i, w in docs if len(w) < 3000]
    big = {i for i, w in docs if len(w) >= 3000}
    got = [r for r in rows(runs.op12_periodic_runs(spark, SF)) if r[0] not in big]
    assert got == sorted(want, key=repr) and sum(r[1] > 0 for r in want) > 5
    assert len(docs) - len(big) > 150


def test_planting(messy):
    want = [(i, " ".join(planted_brute(i, t))) for i, t, *_ in ROWS]
    got = [(r.doc_id, " ".join(re.findall(WORD, r.text or ""))) for r in runs.with_planted_runs(messy).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
