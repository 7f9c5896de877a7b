"""Token counts without token ids: pieces are counted once per distinct pre-token.

Documents are gathered in blocks. A block knows its distinct words, the pre-tokens of each
word and, for each document, how often every word occurs. Only a block's distinct pre-tokens
are shuffled: equal ones meet, the library's model counts the pieces once for all of them, and
the counts are joined to the blocks, where they are summed. A pre-token of all documents has
one row per block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.pieces import tokenizer, vocabulary
from lakecheck.llm.registry import query, table
from lakecheck.session import materialize

#: A block ends when its texts reach this many bytes or rows; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_ROWS = 20 << 20, 65_536
LIMIT = 2048
_MARKS = ".,;:!?"
_BLOCKS = "block long, doc_ids array<long>, n_bytes array<long>, pre_tokens array<string>, parts binary, ends binary, postings binary, doc_ends binary"
_RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def _squeezed(*arrays: np.ndarray) -> bytes:
    """32-bit numbers, as planes of their bytes."""
    planes = [np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.compress(b"".join(planes), 1)


def _restored(data: bytes, n_arrays: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(n_arrays, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


class PreTokens:
    """Pre-tokens of a word without ASCII white space, as strings to count later. A word with
    a special token in it stays whole, marked by a leading space."""

    def __init__(self, lib):
        self.clean, self.cut = lib.normalizer, lib.pre_tokenizer
        self.special = [t.content for t in lib.get_added_tokens_decoder().values()]

    def __call__(self, word: str) -> list[str]:
        core = word.rstrip(_MARKS)
        if core.isascii() and core.isalpha():
            return [core.lower(), word[len(core) :]] if len(core) < len(word) else [core.lower()]
        if any(s in word for s in self.special):
            return [" " + word]
        return [p for p, _ in self.cut.pre_tokenize_str(self.clean.normalize_str(word))]


def _block(number: int, docs: list[tuple[int | None, bytes]], cut: PreTokens) -> dict:
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    words, times, ends = [], [], []
    for _, text in docs:
        parts = text.split()
        found, often = np.unique(np.fromiter(map(index.__getitem__, parts), np.int64, len(parts)), return_counts=True)
        words.append(np.diff(found, prepend=0))  # small numbers, as they are sorted
        times.append(often)
        ends.append(len(found))
    pre: defaultdict[str, int] = defaultdict(count().__next__)
    parts, part_ends = [], []
    for word in index:
        got = [pre[p] for p in cut(word.decode())]
        parts += got
        part_ends.append(len(got))
    return {
        "block": number,
        "doc_ids": [d for d, _ in docs],
        "n_bytes": [len(t) for _, t in docs],
        "pre_tokens": list(pre),
        "parts": _squeezed(np.array(parts, np.int64)),
        "ends": _squeezed(np.cumsum(part_ends, dtype=np.int64)),
        "postings": _squeezed(np.concatenate(words), np.concatenate(times)),
        "doc_ends": _squeezed(np.cumsum(ends)),
    }


def _blocks(library: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = PreTokens(tokenizer(vocabulary(library)))
        number, size, docs = TaskContext.get().partitionId() << 32, 0, []
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4]
        schema = pa.schema([(x.split()[0], t) for x, t in zip(_BLOCKS.split(", "), kinds, strict=True)])
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                docs.append((doc, text.as_py() or b""))
                size += len(docs[-1][1])
                if size >= block_bytes or len(docs) >= BLOCK_ROWS:
                    yield pa.RecordBatch.from_pylist([_block(number, docs, cut)], schema)
                    number, size, docs = number + 1, 0, []
        if docs:
            yield pa.RecordBatch.from_pylist([_block(number, docs, cut)], schema)

    return run


def _count_pieces(library: str):
    """Rows come sorted by pre-token: each is counted where it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = tokenizer(vocabulary(library))
        model = lib.model
        last, n = None, 0
        for batch in batches:
            counts = []
            for p in batch.column(0).to_pylist():
                if p != last:
                    last, n = p, len(lib.encode(p[1:], add_special_tokens=False).ids if p[:1] == " " else model.tokenize(p))
                counts.append(n)
            places = batch.column(2).to_numpy().astype(np.int64) << 32 | np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(places)], ["block", "place_n"])

    return run


def _sums(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = np.array(row["counts"] or [], np.int64)
                pieces = np.zeros(len(known), np.int64)
                pieces[known >> 32] = known & 0xFFFFFFFF
                (parts,), (ends,), (doc_ends,) = (_restored(row[c], 1) for c in ("parts", "ends", "doc_ends"))
                steps, times = _restored(row["postings"], 2)
                upto = np.concatenate([[0], np.cumsum(steps)])
                starts = np.concatenate([[0], doc_ends])
                words = upto[1:] - np.repeat(upto[starts[:-1]], np.diff(starts))
                upto = np.concatenate([[0], np.cumsum(pieces[parts])])
                per_word = np.diff(upto[np.concatenate([[0], ends])])
                upto = np.concatenate([[0], np.cumsum(per_word[words] * times)])
                total = np.diff(upto[starts])
                columns = pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(total), pa.array(total > limit)
                yield pa.RecordBatch.from_arrays(list(columns), schema=_RESULT_ARROW)

    return run


def count_tokens(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", library: str = "word_bpe_49k.json",
    limit: int = LIMIT, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    Counts are those of the library for a tokenizer whose pieces never cross white space;
    special strings inside a text count as its default has it, none are added. Null text is
    the empty text: no bytes, no tokens. Null identifiers and repeated rows are counted like
    others. No rows in: no rows out. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = materialize(slim.mapInArrow(_blocks(library, block_bytes), _BLOCKS), "blocks")
    listed = blocks.select("block", F.posexplode("pre_tokens").alias("place", "pre_token"))
    # all rows of a pre-token side by side: one for each block that has it
    counted = listed.select("pre_token", "block", "place").repartition("pre_token").sortWithinPartitions("pre_token").mapInArrow(_count_pieces(library), "block long, place_n long")
    # as many entries for a block as it has distinct pre-tokens, which its bytes bound
    back = counted.groupBy("block").agg(F.collect_list("place_n").alias("counts"))
    return blocks.drop("pre_tokens").join(back, "block", "left").mapInArrow(_sums(limit), _RESULT)


@query
def op9_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
