from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakecheck.llm import quality, secrets, toxicity

from .conftest import ROWS, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        covered |= {i, i + 1, i + 2} if often[w] > 1 else set()
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def kept_brute(text, model):
    base = base_brute(text)
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    x, chance = quality.statistics(text)[5:], model.start
    for feature, cut, value in zip(model.feature, model.cut, model.value, strict=True):  # one tree at a time
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + int(x[feature[node]] > cut[node])
        chance += value[node - len(feature)]
    return (*base, failed, not failed and 1 / (1 + np.exp(-chance)) >= quality.LEAST_CHANCE)


def test_quality(messy, nothing, documents, labels):
    model = quality.train(documents, labels)
    for df, docs in ((messy, [r[:2] for r in ROWS]), (documents, documents.select("doc_id", "text").collect())):
        got = rows(quality.score_quality(df, model).drop("chance"))
        assert got == sorted(((i, *kept_brute(t, model)) for i, t in docs), key=repr)
    assert rows(quality.score_quality(nothing, model)) == []
    left = quality.drop_poor(messy, model)
    assert left.columns == messy.columns and left.count() == sum(kept_brute(r[1], model)[-1] for r in ROWS)


def test_quality_without_labels(documents, labels, nothing):
    model = quality.train(documents, labels.limit(0))
    assert model.chance(np.zeros((2, len(quality.FEATURES)))).min() > 0.5
    assert quality.train(nothing, labels).chance(np.zeros((1, len(quality.FEATURES))))[0] > 0.5


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.2) ^ (rng.random(4000) < 0.1)).astype(float)
    signs = [-1, 1, 0]
    model = quality.grow(x[:2000], y[:2000], signs, n_trees=30)
    assert ((model.chance(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.85
    for feature, sign in enumerate(signs[:2]):
        for _ in range(50):
            line = np.repeat(rng.random((1, 3)), 101, axis=0)
            line[:, feature] = np.linspace(0, 1, 101)
            assert (sign * np.diff(model.chance(line)) >= -1e-12).all()


def test_network_gradients():
    net = {k: v.astype(float) for k, v in toxicity.new_net(1).items()}
    words, at, d = toxicity.Words.of(["idiot", "the", "of", "thing"]), np.array([[1, 2, 3, 0, 0], [4, 1, 0, 0, 0], [2, 2, 1, 4, 3]]), np.array([1.0, -2, 0.5])

    def inputs():
        return np.concatenate([np.zeros((1, toxicity.WIDTH)), words.embedded(net).astype(float)])

    keep: list = []
    toxicity.forward(net, toxicity.projected(net, inputs()), at, keep)
    grad = toxicity.backward(net, words, inputs(), at, keep, d)
    rng = np.random.default_rng(0)
    for name, value in net.items():
        for _ in range(4):
            place = (words.own[rng.integers(4)], 1) if name == "words" else (words.grams[rng.integers(20)], 2) if name == "chars" else tuple(rng.integers(s) for s in value.shape)
            before, ends = value[place], []
            for step in (1e-2, -1e-2):
                value[place] = before + step
                ends.append((toxicity.forward(net, toxicity.projected(net, inputs()), at) * d).sum())
            value[place] = before
            assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(grad[name][place], abs=2e-3)


def window_brute(net, words):
    """One window's logit, number by number."""
    hidden, width = toxicity.HIDDEN, toxicity.WIDTH

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def embedded(word):
        core = word.strip(toxicity._STRIP).lower() or word.lower()
        line = f"^{core}$".encode()
        grams = [line[i : i + 3] for i in range(len(line) - 2)] + [line[:n] for n in range(4, 8) if n <= len(line)]
        own = net["words"][zlib.crc32(line) % toxicity.WORD_ROWS]
        return [own[k] + sum(net["chars"][zlib.crc32(g) % toxicity.CHAR_ROWS][k] for g in grams) / len(grams) for k in range(width)]

    states = [[0.0] * (2 * hidden) for _ in words]
    for way in (0, 1):
        h = [0.0] * hidden
        for t in range(len(words)) if way == 0 else reversed(range(len(words))):
            x = embedded(words[t])
            gate = [net["bias"][way, 0, j] + sum(x[k] * net["in"][way, k, j] for k in range(width)) for j in range(3 * hidden)]
            back = [sum(h[k] * net["back"][way, k, j] for k in range(hidden)) for j in range(3 * hidden)]
            z, r = ([sigmoid(gate[j] + back[j]) for j in range(at, at + hidden)] for at in (0, hidden))
            new = [math.tanh(gate[2 * hidden + j] + r[j] * back[2 * hidden + j]) for j in range(hidden)]
            h = [z[j] * h[j] + (1 - z[j]) * new[j] for j in range(hidden)]
            states[t][way * hidden : (way + 1) * hidden] = h
    look = [[math.tanh(sum(s[k] * net["look"][k, j] for k in range(2 * hidden))) for j in range(hidden)] for s in states]
    weight = [math.exp(sum(v[j] * net["key"][j] for j in range(hidden))) for v in look]
    pooled = [sum(w * s[k] for w, s in zip(weight, states, strict=True)) / sum(weight) for k in range(2 * hidden)] if words else [0.0] * (2 * hidden)
    return sum(pooled[k] * net["out"][k] for k in range(2 * hidden)) + net["shift"][0]


def test_scores_are_those_of_the_highest_window():
    rng = np.random.default_rng(8)
    some = ["the", "Idiot!", "x", "...", "überlang", "日本語", "#", "a" * 40, "it's", "w1", "w2", "w3"]
    texts = [None, "", " ", "x", "...", *[" ".join(rng.choice(some, n)) for n in (2, 33, 64, 65, 97, 130)]]
    net = toxicity.new_net(3) | {"scale": np.array([1.7]), "offset": np.array([-0.4])}
    net = {k: (v.astype(np.float32) if v.dtype == float and k not in ("scale", "offset") else v) for k, v in net.items()}
    want = []
    for text in texts:
        words, best = WORD.findall(text or ""), -math.inf
        at = 0
        while True:
            best = max(best, window_brute(net, words[at : at + 64]))
            if at + 64 >= len(words):
                break
            at += 32
        want.append(1 / (1 + math.exp(-(1.7 * best - 0.4))))
    assert toxicity.Scorer(net)(texts) == pytest.approx(want, abs=1e-5)


def test_repeated_identifiers_train_one_net(documents, labels):
    """Whatever rows of an identifier come first."""
    few = documents.where("doc_id < 60")
    twice = few.unionByName(few.withColumn("text", F.lit(""))).unionByName(few)
    one, other = (toxicity.train(d, m, steps=3) for d, m in ((few, labels), (twice.repartition(7), labels.union(labels))))
    assert all((one[k] == other[k]).all() for k in one)
    x = np.random.default_rng(2).random((20, len(quality.FEATURES)))
    assert (quality.train(few, labels).chance(x) == quality.train(twice.repartition(7), labels.union(labels)).chance(x)).all()


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 32, 63, 64, 65, 96, 97, 1000):
        covered = [w for s in toxicity.starts_of(n) for w in range(s, min(n, s + toxicity.WINDOW))]
        assert set(covered) == set(range(n)) and (n <= toxicity.WINDOW or max(np.diff(list(toxicity.starts_of(n)))) == toxicity.STRIDE)


def test_toxicity(spark, messy, nothing):
    """Held-out accuracy on documents with insults in them."""
    rng = np.random.default_rng(4)
    plain, rude = [f"w{i}" for i in range(300)], ["numbskull", "dolt", "twerp"]
    docs, labels = [], []
    for i in range(400):
        words = rng.choice(plain, rng.integers(5, 150)).tolist()
        if i % 4 == 0:
            for _ in range(1 + len(words) // 40):
                words[rng.integers(len(words))] = str(rng.choice(rude))
        docs.append((i, " ".join(words))), labels.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = toxicity.score_toxicity(docs, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.9
    scorer = toxicity.Scorer(net)
    out = {r.doc_id: r for r in toxicity.score_toxicity(messy, net).collect()}
    assert len(rows(toxicity.score_toxicity(messy, net))) == len(ROWS)
    for i, text in ((3, None), (4, ""), (6, ROWS[8][1])):
        assert out[i].score == pytest.approx(scorer([text])[0], abs=1e-6)
    assert not out[None].held_out and rows(toxicity.score_toxicity(nothing, net)) == []


def test_toxicity_without_labels(documents, labels, nothing):
    net = toxicity.train(documents, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(documents, net).collect()} == {0}
    assert 0 <= toxicity.Scorer(toxicity.train(nothing, labels))(["a"])[0] <= 1


def test_secrets(spark, messy, nothing):
    rng = np.random.default_rng(6)
    hexa, docs = "0123456789abcdef", []
    for i in range(300):
        number = "".join(rng.choice(list("0123456789"), 16))
        key = "".join(rng.choice(list(hexa), 24))
        docs.append((i, f"some words here {number} and then words password={key} at the end" if i % 2 else f"order number {number} was sent"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = secrets.dictionary(df)
    assert {"words", "order", "number"} <= known
    forest = secrets.train(df, known)
    got = secrets.scan(df, known, forest).collect()
    want = [(i, m.start(), len(m[0])) for i, t in docs for m in re.finditer(r"[A-Za-z0-9+/_\-]{12,}", t) if re.search("[0-9]", m[0])]
    assert sorted((r.doc_id, r.start, r.length) for r in got) == sorted(want)
    assert all(r.secret == (docs[r.doc_id][1][r.start - 1] == "=") for r in got)
    for r in got[:20]:
        x = np.array([secrets.features(docs[r.doc_id][1], r.start, r.start + r.length, known)], float)
        assert r.chance == pytest.approx(forest.chance(x)[0])
    judged = spark.createDataFrame([(i, docs[i][1].index("=") + 1, 0) for i in range(1, 300, 2)] + [(0, docs[0][1].index("number ") + 7, 1)], "doc_id long, start long, label int")
    assert secrets.train(df, known, judged).chance(np.array([secrets.features(docs[1][1], *secrets.candidates(docs[1][1])[1], known)], float))[0] < 0.5
    assert secrets.scan(messy, known, forest).count() == sum(len(secrets.candidates(r[1])) for r in ROWS)
    assert rows(secrets.scan(nothing, known, forest)) == [] and len(secrets.train(nothing, known).share) == secrets.N_TREES
