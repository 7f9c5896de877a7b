"""Content scans: ORC, Parquet, delimited text, gzip text, many small text files."""

from __future__ import annotations

import codecs
import hashlib
import io
import os
import re
import time
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import ExitStack
from functools import cache
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions.paths import one_form
from lakecheck.functions.text import split_fields
from lakecheck.session import tasks_for


def read_orc(spark: SparkSession, *path: str) -> DataFrame:
    return spark.read.orc(list(path))


def read_parquet(spark: SparkSession, *path: str) -> DataFrame:
    return spark.read.parquet(*path)


def read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """``value`` and its ``fields``; no quoting or escaping, unlike a CSV scan."""
    return scan_small_text(spark, path).withColumn("fields", split_fields(F.col("value"), sep))


def scan_small_text(spark: SparkSession, path: str) -> DataFrame:
    """All lines below a folder. Spark packs small files into splits of
    ``maxPartitionBytes``, each weighed with ``openCostInBytes``."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def scan_text_rows(spark: SparkSession, *path: str) -> DataFrame:
    """``path, block_start, row_pos, value`` of every line.

    ``row_pos`` grows by one per line inside a split ``(path, block_start)``, so the line
    number in the file follows from the line counts of the earlier splits; see
    :func:`lakecheck.operators.textcheck.text_verdict`.
    """
    uri = F.col("_metadata.file_path")
    unquoted = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    decoded = F.when(uri.contains("%"), unquoted).otherwise(uri)
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(list(path))
        .select(
            one_form(decoded).alias("path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("row_pos"),
            "value",
        )
    )


@cache
def _client(scheme: str, authority: str):
    """One client per store in a worker, and what its keys start with."""
    from pyarrow import fs

    if scheme == "file":
        return fs.LocalFileSystem(), ""
    store, start = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return store, start.rstrip("/")


def _store(path: str):
    """File system and key of a path as Spark's listing reports it. Only scheme and authority
    are taken as a URI; the key may have any character in it."""
    scheme, _, rest = path.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) else ("file", "", path)
    authority, rest = (rest[2:].split("/", 1) + [""])[:2] if rest.startswith("//") and scheme != "file" else ("", rest)
    store, start = _client(scheme, authority)
    return store, f"{start}/{rest.lstrip('/')}"


#: Starts the message about a file that the store didn't give, which says nothing about its content.
NOT_OPENED = "cannot read: "


def trouble(problem: Exception) -> str:
    """Message of a problem. A missing file, a refusal or a lost connection has a number of the
    operating system; damaged content doesn't."""
    outside = isinstance(problem, OSError) and (problem.errno is not None or isinstance(problem, (FileNotFoundError, PermissionError, TimeoutError, ConnectionError)))
    return f"{NOT_OPENED if outside else ''}{type(problem).__name__}: {problem}"


#: Ending of a folder that stands for one file, cut into parts that several tasks wrote.
PARTS = ".parts"
_PART_NAME = re.compile(r"^part-\d{6}$")


def part_path(target: str, part: int) -> str:
    return f"{target}/part-{part:06d}"


class _Joined(io.RawIOBase):
    """Parts of a file read as one; a part is open at a time."""

    def __init__(self, store, folder: str):
        from pyarrow import fs

        self._at, self._open, self._handle = 0, None, None
        listed = [e for e in store.get_file_info(fs.FileSelector(folder)) if _PART_NAME.match(e.base_name)]
        if not listed:
            raise FileNotFoundError(f"no parts in {folder}")
        self._store, self._parts = store, sorted((e.path, e.size) for e in listed)
        self._ends = list(accumulate(size for _, size in self._parts))

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self._at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + (0, self._at, self._ends[-1])[whence]
        return self._at

    def readinto(self, buffer) -> int:
        number = bisect_right(self._ends, self._at)
        if number == len(self._parts):
            return 0
        path, size = self._parts[number]
        if self._open != number:
            if self._handle:
                self._handle.close()
            self._handle, self._open = self._store.open_input_file(path), number
        self._handle.seek(self._at - (self._ends[number] - size))
        data = self._handle.read(len(buffer))
        buffer[: len(data)] = data
        self._at += len(data)
        return len(data)

    def close(self) -> None:
        if self._handle:
            self._handle.close()
        super().close()


def open_path(path: str) -> pa.NativeFile:
    """Open a file from inside a task, or the parts of one; what may pass is tried twice."""
    store, key = _store(path)
    opened = (lambda: pa.PythonFile(io.BufferedReader(_Joined(store, key)), mode="r")) if key.endswith(PARTS) else (lambda: store.open_input_file(key))
    try:
        return opened()
    except (FileNotFoundError, PermissionError, IsADirectoryError):
        raise
    except OSError:
        time.sleep(1)
        return opened()


def move_file(path: str, target: str) -> None:
    """Give a finished file its name; one that another attempt of the task finished stays."""
    store, key = _store(path)
    try:
        store.move(key, _store(target)[1])
    except OSError:
        from pyarrow import fs

        if store.get_file_info(_store(target)[1]).type != fs.FileType.File:
            raise
        store.delete_file(key)


def open_sink(path: str) -> pa.NativeFile:
    """Open a new file for writing from inside a task, its folder too. The folder is one that
    all executors share; a name that no other attempt of the task takes is up to the caller."""
    store, key = _store(path)
    store.create_dir(key.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(key)


def write_blobs(folder: str, suffix: str = ""):
    """Task body: rows ``part, content`` -> a file ``part=../blob-..`` for each in a folder that
    all executors share; gives ``path, length``. Names follow from the content, so that a
    task that runs twice writes the same files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = []
            for part, content in zip(batch.column("part").to_pylist(), batch.column("content").to_pylist(), strict=True):
                path = f"{folder}/part={part}/blob-{zlib.crc32(content):08x}{suffix}"
                with open_sink(path) as out:
                    out.write(content)
                written.append((path if ":" in path else f"file:{path}", len(content)))
            columns = list(zip(*written, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["path", "length"])

    return run


def copy_files(folder: str, piece: int = 8 << 20):
    """Task body: rows ``part, path, end, zero_from, zero_to`` -> a file ``part=../blob-..`` for each with
    the first ``end`` bytes of ``path``, zeros between those two places; gives ``path, length``. A
    task holds one piece, however large the files are; a copy takes its name once it is whole."""

    def copied(source: str, target: str, end: int, zero_from: int, zero_to: int) -> int:
        at, name = 0, f"{target}.{uuid.uuid4().hex}"
        with open_path(source) as handle, open_sink(name) as out:
            while at < end and (data := handle.read(min(piece, end - at))):
                low, high = max(zero_from - at, 0), min(zero_to - at, len(data))
                out.write(data if low >= high else data[:low] + bytes(high - low) + data[high:])
                at += len(data)
        move_file(name, target)
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            written = []
            for part, source, *places in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "end", "zero_from", "zero_to")), strict=True):
                path = f"{folder}/part={part}/blob-{hashlib.sha1(source.encode()).hexdigest()}"
                written.append((path if ":" in path else f"file:{path}", copied(source, path, *places)))
            columns = list(zip(*written, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["path", "length"])

    return run


def _local_entry(base: str, entry) -> tuple:
    try:
        found, is_dir = entry.stat(), entry.is_dir()
    except OSError:  # gone meanwhile, or a link to nothing
        return f"{base}/{entry.name}", None, None, False
    return f"{base}/{entry.name}", None if is_dir else found.st_size, found.st_mtime_ns // 1000, is_dir


def list_folder(path: str, page: int = 10_000) -> Iterator[list[tuple]]:
    """``path, length, modification time, is folder`` of everything in a folder, in pages. A
    local folder is read page by page, whatever its size; the clients of other stores list
    one whole."""
    from pyarrow import fs

    store, key = _store(path)
    base = path.rstrip("/")
    with ExitStack() as opened:
        if isinstance(store, fs.LocalFileSystem):
            entries = (_local_entry(base, e) for e in opened.enter_context(os.scandir(key)))
        else:
            listed = store.get_file_info(fs.FileSelector(key, recursive=False))
            entries = ((f"{base}/{e.base_name}", e.size, e.mtime, e.type == fs.FileType.Directory) for e in listed)
        while some := list(islice(entries, page)):
            yield some


def _text_pieces(handle, piece: int) -> Iterator[str]:
    """Decompressed text of a gzip stream (also of several members), piece by piece.

    Raises ``EOFError`` if the stream stops early and ``zlib.error`` if it is damaged.
    """
    import gzip

    decode = codecs.getincrementaldecoder("utf-8")(errors="replace").decode
    with gzip.GzipFile(fileobj=handle) as stream:
        while data := stream.read(piece):
            yield decode(data)
    yield decode(b"", True)


def _lines_of(pieces: Iterator[str]) -> Iterator[list[str]]:
    r"""Lists of lines, split at ``\n``, ``\r`` and ``\r\n`` like Spark's text reader."""
    rest = ""
    for text in pieces:
        text = rest + text
        held = "\r" if text.endswith("\r") else ""  # may be half of \r\n
        text = text[: len(text) - len(held)].replace("\r\n", "\n").replace("\r", "\n")
        lines = text.split("\n")
        rest = lines.pop() + held
        if lines:
            yield lines
    if rest:
        yield [rest.removesuffix("\r")]


GZIP_BYTES_PER_TASK = 64 << 20
GZIP_SCHEMA = "path string, line_no bigint, value string, error string"


def read_gzip_lines(files: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """``path`` rows -> all their lines, plus one row with ``error`` per broken stream.

    Needs no ``.gz`` file name. A gzip stream cannot be split, so one task streams one
    file, holding ``piece`` bytes at a time; many files spread over many tasks.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "line_no", "value", "error"]

        def rows(path: str, first: int, lines: list, error: str | None) -> pa.RecordBatch:
            n = len(lines)
            numbers = pa.array(range(first, first + n), pa.int64()) if error is None else pa.nulls(n, pa.int64())
            columns = [pa.array([path] * n, pa.string()), numbers, pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([error] * n, pa.string())], names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                line_no = 1
                try:
                    with open_path(path) as handle:
                        for lines in _lines_of(_text_pieces(handle, piece)):
                            yield rows(path, line_no, lines, None)
                            line_no += len(lines)
                except (OSError, EOFError, zlib.error) as problem:
                    yield rows(path, 0, [None], trouble(problem))

    tasks = tasks_for(files, GZIP_BYTES_PER_TASK)
    return files.select("path").repartition(tasks, "path").mapInArrow(unpack, GZIP_SCHEMA)


TEXT_RANGE = 64 << 20
TEXT_SCHEMA = "path string, block_start bigint, row_pos bigint, value string, error string"
#: Plain text is read in ranges; what has one of these endings is one stream.
_PACKED = r"\.(gz|bz2)(\.parts)?$"


def _range_lines(handle, start: int, end: int | None, piece: int) -> Iterator[list[str]]:
    r"""Lists of the lines that start in a range of bytes, split at ``\n``, ``\r`` and ``\r\n``.

    From the byte before the range on, everything up to the first line end belongs to an
    earlier range, even if it is that byte alone.
    """
    at, rest, skip = max(start - 1, 0), b"", start > 0
    handle.seek(at)
    while True:
        data = handle.read(piece)
        lines = (rest + data).splitlines(keepends=True)
        rest = lines.pop() if data and lines and not lines[-1].endswith(b"\n") else b""  # \r may be half of \r\n
        if skip and lines:
            at += len(lines.pop(0))
            skip = False
        ends = list(accumulate(map(len, lines), initial=at))
        own = len(lines) if end is None else bisect_left(ends, end, 0, len(lines))
        if own:
            yield b"\n".join(x.removesuffix(b"\n").removesuffix(b"\r") for x in lines[:own]).decode("utf-8", "replace").split("\n")
        if not data or own < len(lines) or end is not None and ends[-1] >= end:
            return
        at = ends[-1]


def _stream_lines(path: str, handle, piece: int) -> Iterator[list[str]]:
    if path.removesuffix(PARTS).endswith(".bz2"):
        import bz2

        stream = bz2.BZ2File(handle)
        decode = codecs.getincrementaldecoder("utf-8")(errors="replace").decode
        return _lines_of(chain((decode(data) for data in iter(lambda: stream.read(piece), b"")), iter(lambda: decode(b"", True), "")))
    return _lines_of(_text_pieces(handle, piece))


def read_text_lines(files: DataFrame, range_bytes: int = TEXT_RANGE, piece: int = 1 << 20) -> DataFrame:
    """``path, length`` rows -> ``path, block_start, row_pos, value, error``: all lines of text
    files, like :func:`scan_text_rows`, but a file that can't be read or breaks off gives a
    row with ``error`` where that scan would fail for all files.

    A plain file is cut into ranges of bytes that spread over tasks, each of which reads the
    lines that start in it; a compressed one (``.gz``, ``.bz2``) is a stream for one task. A
    task holds a piece and the line it stands in.
    """
    names = ["path", "block_start", "row_pos", "value", "error"]

    def rows(path: str, start: int, first: int, lines: list, error: str | None) -> pa.RecordBatch:
        n = len(lines)
        at = pa.array(range(first, first + n), pa.int64()) if error is None else pa.nulls(n, pa.int64())
        columns = [pa.array([path] * n, pa.string()), pa.array([start] * n, pa.int64()), at, pa.array(lines, pa.string()), pa.array([error] * n, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end, packed in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "packed"))):
                first = 0
                try:
                    with open_path(path) as handle:
                        for lines in _stream_lines(path, handle, piece) if packed else _range_lines(handle, start, end, piece):
                            yield rows(path, start, first, lines, None)
                            first += len(lines)
                except (OSError, EOFError, zlib.error) as problem:
                    yield rows(path, start, 0, [None], trouble(problem))

    packed = F.col("path").rlike(_PACKED)
    sized = files.select("path", (F.col("length") if "length" in files.columns else F.lit(None).cast("bigint")).alias("length"), packed.alias("packed"))
    last = F.when(F.col("packed") | F.col("length").isNull(), 0).otherwise(F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / range_bytes))
    cut = sized.select("path", "packed", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("n"))
    # the last range ends with the file, however long that is by now
    ranges = cut.select("path", "packed", (F.col("n") * range_bytes).alias("start"), F.when(F.col("n") < F.col("last"), (F.col("n") + 1) * range_bytes).cast("bigint").alias("end"))
    return ranges.repartition(tasks_for(files, max(range_bytes, TEXT_RANGE), 0), "path", "start").mapInArrow(run, TEXT_SCHEMA)
