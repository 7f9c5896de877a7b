"""Arithmetic in GF(2^8) on numpy arrays, and binary columns as such arrays; used inside tasks."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

POLYNOMIAL = 0x11D
#: Cells of so many bytes on average are copied, and summed up, all at once instead of one by one.
SHORT = 64


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """``(product, inverse)``: 256 x 256 products and 256 inverses (of 0: 0)."""
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for e in range(255):
        power[e] = power[e + 255] = x
        log[x] = e
        x = (x << 1) ^ (POLYNOMIAL if x & 0x80 else 0)
    product = power[log[:, None] + log[None, :]]
    product[0, :] = product[:, 0] = 0
    inverse = power[(255 - log) % 255].copy()
    inverse[0] = 0
    return product, inverse


def matmul(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Small matrix ``a`` times ``x``, whose columns are byte positions."""
    product, _ = tables()
    out = np.zeros((a.shape[0], x.shape[1]), np.uint8)
    for j in np.flatnonzero(a.any(axis=0)):
        row = x[j].tobytes()  # bytes.translate looks up twice as fast as numpy indexing
        for i in np.flatnonzero(a[:, j]):
            out[i] ^= np.frombuffer(row.translate(product[a[i, j]].tobytes()), np.uint8)
    return out


def eliminate(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row-reduce ``a``; returns ``(left, null)`` with ``left @ a = I`` if the columns of
    ``a`` are independent, and ``null @ a = 0`` spanning all such rows."""
    product, inverse = tables()
    rows, cols = a.shape
    work = np.concatenate([a, np.eye(rows, dtype=np.uint8)], axis=1).astype(np.uint8)
    rank = 0
    for col in range(cols):
        pivot = next((r for r in range(rank, rows) if work[r, col]), None)
        if pivot is None:
            continue
        work[[rank, pivot]] = work[[pivot, rank]]
        work[rank] = product[inverse[work[rank, col]]][work[rank]]
        for r in range(rows):
            if r != rank and work[r, col]:
                work[r] ^= product[work[r, col]][work[rank]]
        rank += 1
    return work[:rank, cols:], work[rank:, cols:]


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value after the other, and the values' sizes."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of values that lie one after the other in ``data``."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
