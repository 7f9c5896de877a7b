"""What an ORC file says of the values of its stripes, compared with the values decoded from them.

ORC has no checksums: overwritten bytes of a chunk that was stored as it is decode to other
values. Counts, least and greatest values, sums and lengths of each stripe are in the file's
tail, which pyarrow doesn't show.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

_BUCKETS, _INTS, _REALS, _TEXTS, _BYTES, _DATES, _TIMES = 5, 2, 3, 4, 8, 7, 9
_DAY_MS = 86_400_000  # clocks of writer and reader may be in different zones


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Number and value of each field of a message: a number, a double or the bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        elif key & 7 == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("the file's tail is damaged")
        yield key >> 3, value


def _signed(value: int) -> int:
    return value >> 1 ^ -(value & 1)


def _section(data: bytes, codec: str) -> bytes | None:
    """A section of the tail without its compression; null if pyarrow can't undo it."""
    if codec == "UNCOMPRESSED":
        return data
    out, at = [], 0
    while at < len(data):
        head = int.from_bytes(data[at : at + 3], "little")
        chunk, at = data[at + 3 : at + 3 + (head >> 1)], at + 3 + (head >> 1)
        if head & 1:
            out.append(chunk)
        elif codec == "ZLIB":
            out.append(zlib.decompress(chunk, -15))
        elif codec == "SNAPPY":
            out.append(pa.decompress(chunk, _varint(chunk, 0)[0], "snappy", asbytes=True))
        elif codec == "ZSTD":
            out.append(pa.CompressedInputStream(pa.BufferReader(chunk), "zstd").read())
        else:
            return None
    return b"".join(out)


def _columns(footer: bytes) -> list[int]:
    """The numbers of the top columns: the children of the first type."""
    root = next(value for number, value in _fields(footer) if number == 4)
    found = []
    for number, value in _fields(root):
        if number == 2 and isinstance(value, int):
            found.append(value)
        elif number == 2:
            at = 0
            while at < len(value):
                child, at = _varint(value, at)
                found.append(child)
    return found


def stripe_statistics(file, handle) -> list[list[dict]]:
    """For each stripe and top column the fields of its statistics; empty if there are none. ``file``: an
    open ``pyarrow.orc.ORCFile``, ``handle``: its bytes."""
    sizes = (file.stripe_statistics_length, file.file_footer_length)
    handle.seek(file.file_length - 1 - file.file_postscript_length - sum(sizes))
    try:
        said, footer = (_section(handle.read(size), file.compression) for size in sizes)
        if said is None or footer is None:
            return []
        columns = _columns(footer)
        stripes = [[dict(_fields(value)) for number, value in _fields(stripe) if number == 1] for kind, stripe in _fields(said) if kind == 1]
        return [[own[c] for c in columns] for own in stripes]
    except (IndexError, StopIteration, TypeError, OverflowError, struct.error, zlib.error) as problem:
        raise ValueError("the file's tail is damaged") from problem


def differs(values: pa.Array, said: dict) -> bool:
    """Do decoded values contradict their column's statistics? Decimals and nested values are only
    counted, timestamps compared to a day. Statistics that can't be read are damage, too."""
    try:
        return _differs(values, said)
    except (IndexError, KeyError, TypeError, OverflowError, struct.error) as problem:
        raise ValueError("the file's tail is damaged") from problem


def _differs(values: pa.Array, said: dict) -> bool:
    if 1 in said and said[1] != len(values) - values.null_count:
        return True
    kind, present = values.type, len(values) > values.null_count
    if not present:
        return False
    if pa.types.is_boolean(kind) and _BUCKETS in said:
        counts = dict(_fields(said[_BUCKETS])).get(1)
        true = _varint(counts, 0)[0] if isinstance(counts, bytes) else counts
        return true is not None and true != pc.sum(values).as_py()
    if pa.types.is_integer(kind) and _INTS in said:
        told = {n: _signed(v) for n, v in _fields(said[_INTS])}
        seen = pc.min_max(values).as_py()
        return any(n in told and told[n] != v for n, v in ((1, seen["min"]), (2, seen["max"]), (3, pc.sum(values.cast(pa.int64())).as_py())))
    if pa.types.is_floating(kind) and _REALS in said:
        told, exact = dict(_fields(said[_REALS])), values.cast(pa.float64())
        seen, total, weight = pc.min_max(exact).as_py(), pc.sum(exact).as_py(), pc.sum(pc.abs(exact)).as_py()
        usual = all(abs(told.get(n, 0.0)) < float("inf") for n in (1, 2, 3))  # no NaN and none that are infinite
        return usual and (1 in told and seen["min"] != told[1] or 2 in told and seen["max"] != told[2] or 3 in told and not abs(total - told[3]) <= 1e-9 * weight)
    if pa.types.is_string(kind) and _TEXTS in said or pa.types.is_binary(kind) and _BYTES in said:
        told = dict(_fields(said.get(_TEXTS, said.get(_BYTES))))
        if not pa.types.is_string(kind):
            return 1 in told and _signed(told[1]) != pc.sum(pc.binary_length(values)).as_py()
        seen = pc.min_max(values.cast(pa.binary())).as_py()
        length = _signed(told[3]) if 3 in told else None
        return any(n in told and told[n] != v for n, v in ((1, seen["min"]), (2, seen["max"]))) or length not in (None, pc.sum(pc.binary_length(values)).as_py())
    if pa.types.is_date(kind) and _DATES in said:
        told, seen = {n: _signed(v) for n, v in _fields(said[_DATES])}, pc.min_max(values.cast(pa.date32()).cast(pa.int32())).as_py()
        return any(n in told and told[n] != v for n, v in ((1, seen["min"]), (2, seen["max"])))
    if pa.types.is_timestamp(kind) and _TIMES in said:
        told = {n: _signed(v) for n, v in _fields(said[_TIMES])}
        seen = pc.min_max(values.cast(pa.timestamp("ms", kind.tz), safe=False).cast(pa.int64())).as_py()
        return 3 in told and seen["min"] < told[3] - _DAY_MS or 4 in told and seen["max"] > told[4] + _DAY_MS
    return False
