from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from lakecheck.llm import packing, tokencount
from lakecheck.llm.pieces import byte_bpe_ids, tokenizer, vocabulary

from .conftest import ROWS, rows

ODD = [chr(i) for i in range(1, 128)] + [chr(i) for i in range(0xA1, 0x250, 7)] + [
    " ", "  ", "\n", "\r\n", "\x1c", "\x85", "the", " a", "́", " ", "　", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "漢", "😀", "'s", "'LL", "ſ", "...",
]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def ids_of(text):
    return np.array(tokenizer(vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_ids_are_those_of_the_library():
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    for text in odd_texts(10_000):
        assert np.array_equal(byte_bpe_ids(text, *paths), ids_of(text)[:-1])


def check_packing(docs, got, capacity=2048):
    want, pieces, sequences = {}, {}, {}
    for i, t in docs:
        want.setdefault(i, []).append(ids_of(t))
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == want.keys()
    for i, copies in want.items():
        spans = [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for ids in copies for s, n in _spans(len(ids), pieces[i], capacity)]
        assert sorted(spans) == sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[i])
    padding = 0
    for placed in sequences.values():
        at = 0
        for r in sorted(placed, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def _spans(total, pieces, capacity):
    """The cut of one text of this length, taken from the pieces of all texts of its length."""
    if len({r.doc_tokens for r in pieces}) == 1 and len({(r.start, r.length) for r in pieces}) == len(pieces):
        out = sorted((r.start, r.length) for r in pieces)
    else:  # copies may be cut apart in the end: compare those that were not
        out, at = [], 0
        for n in packing.piece_lengths(total, capacity):
            out.append((at, n))
            at += n
    assert sum(n for _, n in out) == total and all(a + n == b for (a, n), (b, _) in zip(out, out[1:], strict=False))
    return out


def test_packing(documents, nothing):
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = packing.pack(documents.repartition(5)).collect()
    total = sum(r.length for r in got)
    assert check_packing(docs, got) < 0.02 * total
    assert packing.pack(nothing).count() == 0


def test_packing_messy_rows(messy):
    got = packing.pack(messy).collect()
    for i in {r[0] for r in ROWS}:
        lengths = [len(ids_of(t)) for j, t, *_ in ROWS if j == i]
        assert sum(r.length for r in got if r.doc_id == i) == sum(lengths)
        assert {r.doc_tokens for r in got if r.doc_id == i} == set(lengths)
    ids = ids_of(ROWS[8][1])
    covered = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 6)
    assert covered == [(s, n, zlib.crc32(ids[s : s + n].tobytes())) for s, n, _ in covered] and covered[0][0] == 0


@pytest.mark.parametrize("n", [1, 31, 32, 63, 64, 95, 96, 1000, 2047, 2048, 2049, 5000])
def test_piece_lengths(n):
    cut = packing.piece_lengths(n)
    assert sum(cut) == n and all(x <= 2048 for x in cut)
    assert all(2048 % x == 0 for x in cut[:-1]) and (0 < n % 2048 < 32 or min(cut) >= 32)


def check_counts(docs, df):
    lib = tokenizer(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in docs:
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert rows(df) == sorted(want, key=repr)


def test_token_counts(spark, messy, nothing, documents):
    check_counts([r[:2] for r in ROWS], tokencount.count_tokens(messy))
    check_counts(documents.select("doc_id", "text").collect(), tokencount.count_tokens(documents.repartition(3), block_bytes=50_000))
    odd = list(enumerate(odd_texts(5000, 2)))
    check_counts(odd, tokencount.count_tokens(spark.createDataFrame(odd, "doc_id long, text string"), block_bytes=20_000))
    assert rows(tokencount.count_tokens(nothing)) == []
