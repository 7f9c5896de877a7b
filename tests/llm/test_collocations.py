from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lakecheck.llm import collocations as col

from .conftest import LONG, ROWS, SF, rows


def counts_brute(docs, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return f, n


def brute(docs, threshold=10, longest=3, top=2000):
    f, n = counts_brute(docs, longest)
    out = []
    for lang, often in f.items():
        held, scored = Counter(), []
        candidates = {p: a for p, a in often.items() if len(p) > 1 and a >= threshold}
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    held[p[i : i + size]] = max(held[p[i : i + size]], a)
        for p, a in candidates.items():
            if p in held and 100 * held[p] >= 50 * a:
                continue
            score, _, left, right = min((1_000_000 * a * a // (often[p[:k]] * often[p[k:]]), k, often[p[:k]], often[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out, key=repr)


def texts(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)] + ["É", "漢字", "a\x1cb", " ", "X"]
    return [
        (rng.choice(["en", "fr", None, "und"]), rng.choice([" ", "  ", "\t"]).join(rng.choice(words[: rng.choice([5, 31])]) + rng.choice([""] * 9 + [".", ", ;", "\n", "\r\n"]) for _ in range(rng.randint(0, 120))))
        for _ in range(n)
    ]


@pytest.mark.parametrize(("shards", "longest", "slots", "chunk"), [(2, 3, 1 << 16, 1000), (1, 3, 64, 300), (3, 3, 256, 10**6), (4, 4, 1 << 16, 500), (2, 2, 2, 100)])
def test_every_count_is_exact(spark, shards, longest, slots, chunk):
    """Few slots activate phrases early, many shards activate them in many scans."""
    docs = texts(shards)
    f, n = counts_brute(docs, longest)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = col.frequent_phrases(df, longest=longest, shards=shards, slots=slots, chunk_bytes=chunk).collect()
    want = [(lang, " ".join(p), len(p), a) for lang in f for p, a in f[lang].items() if a >= 10] + [(lang, "", 0, k) for lang, k in n.items()]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert any(len(p) == 3 and a >= 10 for lang in f for p, a in f[lang].items()) or longest == 2


def test_against_brute_force(spark):
    docs = texts(9, 900)
    df = spark.createDataFrame(docs, "lang string, text string")
    small = {"slots": 1 << 16}
    assert rows(col.collocations(df, **small)) == brute(docs)
    assert rows(col.collocations(df, threshold=5, longest=4, top=7, shards=3, **small)) == brute(docs, 5, 4, 7)


def test_messy_rows(messy, nothing):
    want = brute([(lang, t) for _, t, lang, *_ in ROWS])
    assert rows(col.collocations(messy, slots=1 << 16)) == want and want
    assert rows(col.collocations(nothing, slots=1 << 16)) == []
    assert len(LONG.split()) > 40_000


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of 10^14, as of a very large corpus, put in place of the scans' result."""
    a, left, right = 123_456_789_012_345, 987_654_321_098_765, 130_000_000_000_000
    known = [("en", "", 0, 10**15), ("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)]
    monkeypatch.setattr(col, "frequent_phrases", lambda docs, *_, **__: spark.createDataFrame(known, "lang string, phrase string, size int, n long"))
    got = col.collocations(spark.createDataFrame([("en", "x")], "lang string, text string")).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, left, right, 10**15, 1_000_000 * a * a // (left * right))]


def test_query_against_brute_force(spark, documents):
    docs = [(r.lang, r.text) for r in documents.collect()]
    assert rows(col.op11_collocations(spark, SF)) == brute(docs)
