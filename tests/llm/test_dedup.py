from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lakecheck.llm import exact, passages, simhash
from lakecheck.llm.components import components

from .conftest import ROWS, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact_brute(docs, best):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, seen = (best(known) if known else None), False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(text.encode()).hexdigest()))
            seen |= i == keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(messy, nothing, documents, keep):
    best = {"min": min, "max": max}[keep]
    assert rows(exact.exact_groups(messy, keep=keep)) == exact_brute([r[:2] for r in ROWS], best)
    assert rows(exact.exact_groups(nothing, keep=keep)) == []
    wide = documents.repartition(70)  # more than one merge of runs
    assert rows(exact.exact_groups(wide, keep=keep)) == exact_brute(documents.select("doc_id", "text").collect(), best)


def test_exact_merge_rounds(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else f"t{i % 50}") for i in range(600)], "doc_id long, text string").repartition(40)
    numbered = exact.materialize(exact.with_digest(docs, exact.F.col("text")), "t")
    merged = exact.merge_runs(numbered, fan_bits=1)
    assert merged.where("_n = 400").select("_keep").distinct().collect()[0][0] == 1
    assert rows(exact.exact_groups(docs)) == exact_brute([tuple(r) for r in docs.collect()], min)


def test_drop_copies(messy, nothing):
    left = exact.drop_copies(messy, keep="max")
    assert left.columns == messy.columns
    assert len({r[1] or "" for r in ROWS}) == left.count()
    assert {r.doc_id for r in left.where("text LIKE 'The cat%'").collect()} == {2}
    assert exact.drop_copies(nothing).count() == 0


def fingerprint_brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_brute(values, least):
    f, parent = np.array(values, np.uint64), list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    small = defaultdict(list)
    for i, x in enumerate(least):
        small[find(i)] += [x] if x is not None else []
    return [min(small[find(i)], default=None) for i in range(len(f))]


def near_brute(docs):
    f = [fingerprint_brute(t) for _, t in docs]
    return sorted(((i, f"{x:016x}", c) for (i, _), x, c in zip(docs, f, components_brute(f, [i for i, _ in docs]), strict=True)), key=repr)


def test_near_groups(messy, nothing, documents):
    assert rows(simhash.near_groups(messy)) == near_brute([r[:2] for r in ROWS])
    assert rows(simhash.near_groups(documents)) == near_brute(documents.select("doc_id", "text").collect())
    assert rows(simhash.near_groups(nothing)) == []


@pytest.mark.parametrize("most", [512, 8])
def test_near_links_in_dense_groups(spark, most):
    rng, values = np.random.default_rng(1), set()
    for start in rng.integers(0, 2**63, 15):
        at = int(start)
        for _ in range(40):
            other = at
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                other ^= 1 << int(bit)
            values.add(other)
            at = other if rng.random() < 0.3 else at
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most)
    root = dict(map(tuple, components(links).collect()))
    assert [root.get(v, v) for v in signed] == components_brute([v % (1 << 64) for v in signed], signed)


def test_masks_cover_every_pair():
    rng = random.Random(2)
    for radius in (1, 2, 3):
        tables = [m % (1 << 64) for m in simhash.masks(radius)]
        assert len(tables) == 2 ** (radius + 1) - 1
        for _ in range(500):
            differ = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(not m & differ for m in tables)
        finer = [m % (1 << 64) for m in simhash._finer(simhash.masks(radius)[0], radius)]
        open_bits = [b for b in range(64) if not tables[0] >> b & 1]
        differ = sum(1 << b for b in rng.sample(open_bits, radius))
        assert any(not m & differ for m in finer)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    root = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert root == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def test_drop_near_copies(messy, nothing):
    left = simhash.drop_near_copies(messy)
    assert left.columns == messy.columns
    assert [r.doc_id for r in left.where("text LIKE '_he cat%'").collect()] == [1]
    assert left.where("doc_id IS NULL").count() == 2 and simhash.drop_near_copies(nothing).count() == 0


def passages_brute(docs, width):
    cut, first = [WORD.findall(t or "") for _, t in docs], {}
    order = [float("inf") if i is None else i for i, _ in docs]
    for k, words in zip(order, cut, strict=True):
        for s in range(len(words) - width + 1):
            window = tuple(words[s : s + width])
            first[window] = min(first.get(window, k), k)
    out = []
    for (i, _), k, words in zip(docs, order, cut, strict=True):
        gone = set()
        for s in range(len(words) - width + 1):
            if first[tuple(words[s : s + width])] < k:
                gone.update(range(s, s + width))
        kept = " ".join(w for at, w in enumerate(words) if at not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_passages(messy, nothing, documents):
    assert rows(passages.remove_passages(messy)) == passages_brute([r[:2] for r in ROWS], 50)
    assert rows(passages.remove_passages(documents)) == passages_brute(documents.select("doc_id", "text").collect(), 50)
    assert rows(passages.remove_passages(nothing)) == []


def test_passages_across_small_blocks(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") for _ in range(60)] for _ in range(5)]
    docs = []
    for i in range(200):
        words = []
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, 50)
            words += rng.choice(base)[at : at + rng.randint(0, 30)] + [rng.choice("xyzé　")] * rng.randint(0, 2)
        docs.append((rng.choice([None, i, i, i, i // 2]), rng.choice([" ", "\n", "\t "]).join(words)))
    got = passages.remove_passages(spark.createDataFrame(docs, "doc_id long, text string"), width=12, block_bytes=2000)
    want = passages_brute(docs, 12)
    assert rows(got) == want and sum(r[2] for r in want) > 100


def test_one_passage_in_most_documents(spark):
    hot = " ".join(f"h{i}" for i in range(70))
    docs = [(i, f"x{i} {hot} y{i}" if i % 3 else f"only{i}") for i in range(300)]
    got = passages.remove_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(9), block_bytes=4000)
    assert rows(got) == passages_brute(docs, 50)

