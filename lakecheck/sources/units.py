"""Files of erasure-coded units: their cells as rows, and files put together from cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.operators.gf import SHORT, flat_bytes
from lakecheck.session import tasks_for
from lakecheck.sources.tables import move_file, open_path, open_sink, part_path, trouble

#: Bytes of a unit file that one row of work stands for, and of cells that a task holds.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
BATCH_CELLS = 10_000
PART_BYTES = 128 << 20
CELL_SCHEMA = "group_id bigint, stripe_no int, unit_index int, payload binary, error string"
_CELLS = pa.schema([("group_id", pa.int64()), ("stripe_no", pa.int32()), ("unit_index", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
ENDED = "file ended early"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges come sorted by path and start; a file stays open for all of its ranges in a task, those that
    follow each other are read as one, and cells of short ranges go out together."""
    held, n_bytes, n_held = [], 0, 0

    def batch_of(group: int, unit: int, stripe: int, data: bytes, cell: int) -> pa.RecordBatch:
        n = -(-len(data) // cell)
        ends = np.minimum(np.arange(n + 1, dtype=np.int64) * cell, len(data)).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)])
        columns = [np.full(n, group, np.int64), np.arange(stripe, stripe + n, dtype=np.int32), np.full(n, unit, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), payload, pa.nulls(n, pa.string())], schema=_CELLS)

    def broken(group: int, unit: int, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((group, None, unit, None, error), _CELLS, strict=True)], schema=_CELLS)

    def joined(ranges: Iterator[tuple]) -> Iterator[tuple]:
        run = None
        for *key, start, end in ranges:
            if run is not None and run[0] == key and run[2] == start:
                run[2] = end
                continue
            if run is not None:
                yield *run[0], *run[1:]
            run = [key, start, end]
        if run is not None:
            yield *run[0], *run[1:]

    def pieces(ranges: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        try:
            for path, group, unit, cell, start, end in ranges:
                stripe, at = start // cell, start
                try:
                    if path != opened:
                        if handle is not None:
                            handle.close()
                        opened, handle = None, None
                        handle = open_path(path)
                        opened = path
                    handle.seek(start)
                    while at < end:
                        data = handle.read(min(max(BATCH_BYTES // cell, 1) * cell, end - at))
                        if data:
                            yield batch_of(group, unit, stripe, data, cell)
                        if len(data) % cell and at + len(data) < end or not data:
                            yield broken(group, unit, ENDED)
                            break
                        stripe, at = stripe + len(data) // cell, at + len(data)
                except OSError as problem:
                    opened = None
                    yield broken(group, unit, trouble(problem))
        finally:
            if handle is not None:
                handle.close()

    names = ("path", "group_id", "unit_index", "cell_size", "start", "end")
    for piece in pieces(joined(row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True))):
        held.append(piece)
        n_bytes, n_held = n_bytes + piece.nbytes, n_held + piece.num_rows
        if n_held >= BATCH_CELLS or n_bytes >= BATCH_BYTES:
            yield pa.concat_batches(held)
            held, n_bytes, n_held = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def scan_unit_cells(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``group_id, stripe_no, unit_index, payload, error``: the cells of captured unit files.

    ``files``: ``path, length, group_id, unit_index, cell_size``; a unit file is the unit's cells
    one after the other, the last of them may be short. Files are cut into ranges of whole
    cells, so that a large one is read by many tasks and no task holds more than a few
    cells. Ranges of the same 64 MB of a file are read by one task, so that a short file is opened once. A file that can't be opened, or is shorter than ``length`` says, gives a row with
    ``error`` in place of the cells that are missing. Empty files have no cells.
    """
    per_range = F.greatest(F.floor(F.lit(range_bytes) / F.col("cell_size")), F.lit(1)) * F.col("cell_size")
    sized = files.where("length > 0").select("path", "length", "group_id", F.col("unit_index").cast("int"), "cell_size", per_range.cast("bigint").alias("step"))
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / F.col("step")).cast("bigint"))).alias("n"))
    ranges = cut.select("path", "group_id", "unit_index", "cell_size", (F.col("n") * F.col("step")).alias("start"), F.least((F.col("n") + 1) * F.col("step"), F.col("length")).alias("end"))
    near = F.floor(F.col("start") / max(range_bytes, RANGE_BYTES))
    return ranges.repartition(tasks_for(files, max(range_bytes, RANGE_BYTES), 0), "path", near).sortWithinPartitions("path", "start").mapInArrow(_cells, CELL_SCHEMA)


def _open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            try:
                with open_path(path) as handle:
                    errors.append(None if handle.size() >= (length or 0) else ENDED)
            except OSError as problem:
                errors.append(trouble(problem))
        yield pa.RecordBatch.from_arrays([batch.column("group_id"), pa.array(errors, pa.string())], ["group_id", "error"])


def unread_groups(files: DataFrame) -> DataFrame:
    """``group_id, error`` of the groups with a unit file that can't be opened or is shorter than
    listed; opens every file and reads none."""
    opened = files.select("path", F.col("length").cast("bigint").alias("length"), F.col("group_id").cast("bigint").alias("group_id"))
    told = opened.repartition(tasks_for(files, RANGE_BYTES, 64), "path").mapInArrow(_open_all, "group_id bigint, error string")
    return told.where("error is not null").groupBy("group_id").agg(F.min("error").alias("error"))


def _write_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``_key, part, target, start, end, at, payload`` by key, part and at: a file for each part, with
    zeros where nothing was given. A part's first row names it and has no payload; pieces without
    one belong to no target. A part takes its name once it is whole."""
    now, out, name, target, begin, at, end = None, None, None, None, 0, 0, 0

    def filled(upto: int) -> None:
        for _ in range(at, upto, BATCH_BYTES):
            out.write(bytes(min(BATCH_BYTES, upto - _)))

    def closed() -> pa.RecordBatch:
        filled(end)
        out.close()
        move_file(name, part_path(target, now[1]))
        return pa.RecordBatch.from_arrays([pa.array([target]), pa.array([now[1]], pa.int32()), pa.array([end - begin], pa.int64())], ["target", "part", "length"])

    def add(payload: pa.Array, where: np.ndarray) -> None:
        nonlocal at
        data, size = flat_bytes(payload)
        ends = where + size
        if len(data) <= SHORT * len(size) and where[0] >= at and (where[1:] >= ends[:-1]).all() and ends[-1] <= end and ends[-1] - at <= BATCH_BYTES:
            # short cells that follow each other, in one piece with the zeros between them
            whole = np.zeros(int(ends[-1]) - at, np.uint8)
            whole[np.repeat(where - at - (np.cumsum(size) - size), size) + np.arange(len(data))] = data
            out.write(whole.tobytes())
            at = int(ends[-1])
            return
        begins = np.cumsum(size) - size
        for row, place in enumerate(where.tolist()):
            if place < at or place >= end:  # a second cell for the same place, or past the end
                continue
            filled(place)
            n = min(int(size[row]), end - place)
            out.write(data[begins[row] : begins[row] + n].tobytes())
            at = place + n

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("_key").dictionary_encode()
        code, part, where = codes.indices.to_numpy(), batch.column("part").to_numpy(), batch.column("at").to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (part[1:] != part[:-1])]))
        for low, high in zip(new.tolist(), [*new[1:].tolist(), len(code)], strict=True):
            key = codes.dictionary[int(code[low])].as_py(), int(part[low])
            if key != now:
                if out is not None:
                    yield closed()
                now, out, target = key, None, batch.column("target")[low].as_py()
                if target is not None:
                    at, end = batch.column("start")[low].as_py(), batch.column("end")[low].as_py()
                    begin, name = at, f"{part_path(target, key[1])}.{uuid.uuid4().hex}"
                    out = open_sink(name)
                    low += 1
            if out is not None and low < high:
                add(batch.column("payload").slice(low, high - low), where[low:high])
    if out is not None:
        yield closed()


def write_parts(pieces: DataFrame, targets: DataFrame, part_bytes: int = PART_BYTES, key: str = "target") -> DataFrame:
    """Write files from their pieces; returns ``target, part, length`` of what was written.

    ``pieces``: ``target, at, payload``: bytes and where they go; ``targets``: ``target, length``,
    each target a folder name that ends with :data:`lakecheck.sources.tables.PARTS` and
    reads like one file. With ``key``, a column of both that is a number for each target, pieces need no
    ``target``, and short ones don't carry its name along. A part is written by one task, so a
    large file by many, and no file or part is ever held as one value. Bytes that no piece gives are
    zeros; those past a file's end, or of no target, are left out. Nothing is joined: the row that
    names a part comes before its pieces.
    """
    sized = targets.select(F.col(key).alias("_key"), "target", F.col("length").cast("bigint").alias("_size"))
    every = sized.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("_size") - 1, F.lit(0)) / part_bytes))).alias("part"))
    start = F.col("part") * part_bytes
    bare = every.select("_key", F.col("part").cast("int").alias("part"), "target", start.alias("start"), F.least(start + part_bytes, F.col("_size")).alias("end"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("payload"))
    known = pieces.select(F.col(key).alias("_key"), F.col("at").cast("bigint").alias("at"), "payload", F.octet_length("payload").cast("bigint").alias("_n")).where("_n > 0")
    cut = known.select("*", F.explode(F.sequence(F.floor(F.col("at") / part_bytes), F.floor((F.col("at") + F.col("_n") - 1) / part_bytes))).alias("part"))
    low, high = F.greatest(F.col("at"), start), F.least(F.col("at") + F.col("_n"), start + part_bytes)
    body = F.when(high - low == F.col("_n"), F.col("payload")).otherwise(F.substring(F.col("payload"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int")))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("target", "string"), ("start", "bigint"), ("end", "bigint"))]
    rows = cut.select("_key", F.col("part").cast("int").alias("part"), *nothing, low.alias("at"), body.alias("payload")).unionByName(bare)
    dealt = rows.withColumn("_file", F.xxhash64("_key", "part")).repartition("_file").sortWithinPartitions("_file", "_key", "part", "at").drop("_file")
    return dealt.mapInArrow(_write_parts, "target string, part int, length bigint")
