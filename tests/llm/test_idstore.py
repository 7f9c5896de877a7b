from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecheck.llm import idstore
from lakecheck.llm.pieces import tokenizer, vocabulary
from lakecheck.sources.tables import open_path

from .conftest import ROWS, SF, rows
from .test_tokens import odd_texts


def ids_of(text):
    return np.array(tokenizer(vocabulary("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def stored_brute(docs):
    """Rows of different texts with one key may lie in any order: key -> sorted ids, and starts."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    return [(i, ids_of(t)) for i, t in docs]


def check(docs, got):
    want = stored_brute(docs)
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 20_000])
def test_perfect_hash(n):
    rng = random.Random(n)
    keys = np.array(list({rng.randrange(-(2**63), 2**63) for _ in range(n)}), np.int64)
    hashed = idstore.PerfectHash.of(keys)
    assert sorted(hashed.slots(keys).tolist()) == list(range(n))
    assert len(hashed.bits) * 8 <= 4 * n + 64 * len(hashed.levels)
    assert n == 0 or len(set(idstore.mixed(keys, 0).tolist())) == n


def test_a_shard_file():
    keys, texts = [None, None, -5, -5, 3, 9], [b"a", b"", b"bb", b"ccc", b"d", b"e" * 100]
    ids = [np.frombuffer(t, np.uint8).astype("<u2") for t in texts]
    tail, sections = idstore.index_of(keys, [len(i) for i in ids])
    note = idstore.json.dumps(tail | {"dtype": "<u2"}).encode()
    data = b"".join(i.tobytes() for i in ids) + b"".join(s.tobytes() for s in sections.values()) + note + len(note).to_bytes(4, "little") + idstore.MAGIC
    shard = idstore.Shard(pa.BufferReader(data))
    at, low, high = shard.rows(np.array([9, 4, -5, 3, 2**62]))
    assert sorted(zip(at.tolist(), low.tolist(), high.tolist(), strict=True)) == [(0, 5, 6), (2, 2, 4), (3, 4, 5)]
    got = [bytes(np.frombuffer(i, "<u4").astype(np.uint8)) for _, _, i in shard.read(np.arange(6))]
    assert got == texts
    with pytest.raises(ValueError):
        idstore.Shard(pa.BufferReader(data[:-1]))


def test_messy_rows(messy, nothing):
    manifest = idstore.write_ids(messy, shard_bytes=10_000)
    check([r[:2] for r in ROWS], idstore.read_ids(messy, manifest).collect())
    assert rows(idstore.read_ids(messy, idstore.write_ids(nothing))) == []
    assert rows(idstore.read_ids(nothing, manifest)) == []


def test_odd_words(spark):
    docs = list(enumerate(odd_texts(4000, 3)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    check(docs, idstore.read_ids(df, idstore.write_ids(df)).collect())


def test_words_beyond_the_memory(spark, monkeypatch):
    monkeypatch.setattr(idstore, "MOST_KNOWN", 7)
    known = idstore.WordIds("word_bpe_49k.json", np.dtype("<u4"))
    text = " ".join(odd_texts(200, 4))
    assert b"".join(known[w] for w in text.encode().split()) == ids_of(text)[:-4]


def test_a_key_of_many_rows_spreads_over_shards(spark):
    docs = spark.range(3000).select(F.expr("IF(id % 3 = 0, id, 7)").alias("doc_id"), F.expr("IF(id % 2 = 0, 'same text', concat('text ', id))").alias("text"))
    manifest = idstore.write_ids(docs.repartition(5), shard_bytes=4000)
    held = manifest.where("first_key <= 7 and last_key >= 7").count()
    assert held > 3 and manifest.agg(F.max("n_rows")).first()[0] < 1500
    check([tuple(r) for r in docs.collect()], idstore.read_ids(docs, manifest).collect())
    some = spark.createDataFrame([(7,), (7,), (8,), (9,), (-1,), (None,), (2**62,)], "doc_id long")
    found = idstore.read_ids(some, manifest).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {7: 2000, 9: 1}


def test_only_files_of_the_manifest_count(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    lost = idstore.write_ids(docs, str(tmp_path / "ids"))  # as by an attempt that was lost
    manifest = idstore.write_ids(docs, str(tmp_path / "ids"))
    assert not {r.path for r in lost.collect()} & {r.path for r in manifest.collect()}
    assert idstore.read_ids(docs, manifest).count() == 50


def test_query_against_the_library(spark, documents):
    want, at = [], 0
    for i, ids in stored_brute(documents.select("doc_id", "text").collect()):
        want.append((i, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert rows(idstore.op13_token_ids(spark, SF)) == sorted(want, key=repr)


def test_paths_open_again(spark, documents):
    manifest = idstore.write_ids(documents)
    for r in manifest.collect():
        with open_path(r.path) as handle:
            shard = idstore.Shard(handle)
            assert len(shard.starts) == r.n_rows + 1 and shard.starts[-1] == r.n_ids
