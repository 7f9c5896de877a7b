"""Can every byte of an ORC or Parquet file be decoded? One verdict per file, one job.

A file is cut into its row groups or stripes, and each of them is read in whatever task
it hashes to, so that one very large file keeps many tasks busy. A damaged file gives an
``error`` row where a plain scan would fail the job, also if its bytes kill the native reader, which
runs in a child process of the task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.paths import is_marker, one_form
from lakecheck.operators.apart import Apart, Crash
from lakecheck.operators.lookup import route_format
from lakecheck.operators.orcstats import differs, stripe_statistics
from lakecheck.operators.textcheck import check_gzip_delimited, check_text_files
from lakecheck.session import materialize, tasks_for
from lakecheck.sources.tables import NOT_OPENED, open_path, trouble

UNIT_SCHEMA = "path string, unit int, file_rows bigint, error string"
READ_SCHEMA = "path string, unit int, file_rows bigint, read_rows bigint, error string"
BYTES_PER_TASK = 512 << 20
FILES_PER_TASK = 64
UNSUPPORTED = "ArrowNotImplementedError"


class _Parquet:
    """Row groups of a Parquet file, with page checksums where the writer stored them.

    A very large row group is cut further into ranges of column chunks.
    """

    def __init__(self, handle) -> None:
        import pyarrow.parquet as pq

        self._file = pq.ParquetFile(handle, page_checksum_verification=True, pre_buffer=False)
        meta = self._file.metadata
        self.rows = meta.num_rows
        self._parts = [
            (group, columns)
            for group in range(meta.num_row_groups)
            for columns in _column_ranges(meta.num_columns, meta.row_group(group).total_byte_size)
        ]
        self.units = len(self._parts)

    def _said(self, group: int, columns: list[int]) -> dict[str, tuple]:
        """Name -> what the footer says of a flat column's chunk: nulls, least and greatest value,
        null where it says nothing. Bounds may be rounded outwards, so values lie within."""
        out = {}
        for i in columns:
            leaf, chunk = self._file.metadata.schema.column(i), self._file.metadata.row_group(group).column(i)
            stats = chunk.statistics if "." not in leaf.path and leaf.max_repetition_level == 0 else None
            if stats is not None:
                plain = leaf.physical_type in ("INT32", "INT64", "FLOAT", "DOUBLE") and leaf.logical_type.type in ("NONE", "INT")
                bounds = stats.has_min_max and plain and stats.min == stats.min and stats.max == stats.max
                out[leaf.path] = (stats.null_count if stats.has_null_count else None, *((stats.min, stats.max) if bounds else (None, None)))
        return out

    def read(self, unit: int) -> int:
        """Decode one part; its rows count for the file only in the first column range. Decoded
        values have to lie within what the footer says of their chunk: without checksums,
        overwritten bytes may well decode."""
        group, columns = self._parts[unit]
        said, n_rows, nulls = self._said(group, columns), 0, Counter()
        for batch in self._file.reader.iter_batches(16384, row_groups=[group], column_indices=columns, use_threads=False):
            n_rows += batch.num_rows
            for name, (_, least, greatest) in said.items():
                values = batch.column(name)
                nulls[name] += values.null_count
                if least is not None:
                    seen = pc.min_max(values).as_py()  # of floats without NaN
                    if seen["min"] is not None and not least <= seen["min"] <= seen["max"] <= greatest and seen["min"] == seen["min"]:
                        raise ValueError(f"values of {name} in row group {group} leave the range of the footer")
        for name, (n_null, _, _) in said.items():
            if n_null is not None and n_null != nulls[name]:
                raise ValueError(f"nulls of {name} in row group {group} differ from the footer")
        if n_rows != self._file.metadata.row_group(group).num_rows:
            raise ValueError(f"row group {group} has {n_rows} rows")
        return n_rows if columns[:1] in ([0], []) else 0


def _column_ranges(n_columns: int, n_bytes: int) -> list[list[int]]:
    pieces = max(1, min(n_columns, math.ceil(n_bytes / BYTES_PER_TASK)))
    step = max(1, math.ceil(n_columns / pieces))
    return [list(range(a, min(a + step, n_columns))) for a in range(0, max(n_columns, 1), step)]


class _Orc:
    """Stripes of an ORC file; their values have to be what the file's statistics say of them."""

    def __init__(self, handle) -> None:
        from pyarrow import orc

        self._file = orc.ORCFile(handle)
        self.rows = self._file.nrows
        self.units = self._file.nstripes
        self._handle, self._said = handle, None

    def read(self, unit: int) -> int:
        if self._said is None:
            self._said = stripe_statistics(self._file, self._handle)
        rows = self._file.read_stripe(unit)
        for name, values, said in zip(rows.schema.names, rows.columns, self._said[unit] if self._said else ()):
            if differs(values, said):
                raise ValueError(f"values of {name} in stripe {unit} differ from the statistics")
        return rows.num_rows


_PROBLEMS = (OSError, ValueError, EOFError, NotImplementedError, pa.ArrowException)


def _units_of(opener: Callable):
    """A path's units as rows, or one row with ``unit`` null."""

    def units(path: str) -> list[tuple]:
        try:
            with open_path(path) as handle:
                file = opener(handle)
                return [(path, unit, file.rows, None) for unit in (range(file.units) if file.units else [None])]
        except _PROBLEMS as problem:
            return [(path, None, None, trouble(problem))]

    return units


def _reader(opener: Callable):
    """Rows read and error of a unit; neighbouring units of a file share its handle."""
    opened, handle, file = None, None, None

    def read(path: str, unit: int) -> tuple[int, str | None]:
        nonlocal opened, handle, file
        try:
            if path != opened:
                opened, handle = None, open_path(path)
                file, opened = opener(handle), path
            return file.read(unit), None
        except _PROBLEMS as problem:
            opened = None
            return 0, trouble(problem)

    return read


def _list_units(opener: Callable):
    """Task body: paths -> one row per unit, or one row with ``unit`` null. A file whose bytes
    bring its reader down is a damaged one like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Apart(_units_of(opener)) as units:
            for batch in batches:
                out = []
                for path in batch.column("path").to_pylist():
                    try:
                        out += units(path)
                    except Crash as problem:
                        out.append((path, None, None, trouble(problem)))
                columns = list(zip(*out)) or [()] * 4
                types = (pa.string(), pa.int32(), pa.int64(), pa.string())
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, ["path", "unit", "file_rows", "error"])

    return run


def _read_units(opener: Callable):
    """Task body: read the units to the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Apart(_reader(opener)) as read:
            for batch in batches:
                counts, errors = [], []
                for path, unit, error in zip(*(batch.column(c).to_pylist() for c in ("path", "unit", "error"))):
                    n_rows = 0
                    if error is None and unit is not None:
                        try:
                            n_rows, error = read(path, unit)
                        except Crash as problem:
                            error = trouble(problem)
                    counts.append(n_rows)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("path"),
                        batch.column("unit"),
                        batch.column("file_rows"),
                        pa.array(counts, pa.int64()),
                        pa.array(errors, pa.string()),
                    ],
                    ["path", "unit", "file_rows", "read_rows", "error"],
                )

    return run


def _check(files: DataFrame, opener: Callable) -> DataFrame:
    opening = tasks_for(files, BYTES_PER_TASK, FILES_PER_TASK)
    reading = tasks_for(files, BYTES_PER_TASK, 0)
    units = files.select("path").repartition(opening, "path").mapInArrow(_list_units(opener), UNIT_SCHEMA)
    spread = units.repartition(reading, "path", "unit").sortWithinPartitions("path", "unit")
    read = materialize(spread.mapInArrow(_read_units(opener), READ_SCHEMA), "units-read")  # a short row per unit
    bad = F.col("error").isNotNull()
    per_file = read.groupBy("path").agg(
        F.min(F.when(bad, F.coalesce("unit", F.lit(-1)))).alias("first"),  # numbers alone: hash aggregation
        F.max("file_rows").alias("n_rows"),
        F.sum("read_rows").alias("read_rows"),
        F.count("unit").alias("n_units"),
    )
    errors = read.where(bad).select("path", F.coalesce("unit", F.lit(-1)).alias("first"), "error").groupBy("path", "first").agg(F.min("error").alias("error"))
    found = per_file.join(errors, ["path", "first"], "left")
    short = F.col("read_rows") != F.col("n_rows")
    unchecked = F.col("error").startswith(UNSUPPORTED) | F.col("error").startswith(NOT_OPENED)
    status = F.when(unchecked, 1).when(F.col("error").isNotNull() | short, -1).otherwise(0)
    return found.select(
        "path",
        status.cast("int").alias("status"),
        F.coalesce("error", F.when(short, "rows read differ from the footer")).alias("msg"),
        "n_rows",
        "n_units",
    )


def check_parquet(files: DataFrame) -> DataFrame:
    """``path, status, msg, n_rows, n_units`` of Parquet files; ``length`` sizes the tasks. A
    file that the store doesn't give is not checked: status 1."""
    return _check(files, _Parquet)


def check_orc(files: DataFrame) -> DataFrame:
    """``path, status, msg, n_rows, n_units`` of ORC files, likewise."""
    return _check(files, _Orc)


MARKER = "marker file"


def check_content(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``path, format, status, msg`` of files (``path, length, table``), each read to its end by
    the format of its table."""
    routed = materialize(route_format(files.select("path", "length", "table"), registry).select("path", "length", "format"), "routed")
    present = {row["format"] for row in routed.select("format").distinct().collect()}  # a handful
    checks = {
        "orc": check_orc, "parquet": check_parquet,
        "text_gzip": lambda own: check_gzip_delimited(own, registry), "text": lambda own: check_text_files(own, registry),
    }
    unknown = ~F.col("format").isin(*checks)
    out = routed.where(unknown).select("path", "format", F.lit(1).alias("status"), F.concat(F.lit("no check for format "), F.col("format")).alias("msg"))
    for fmt in sorted(present & checks.keys()):
        own = routed.where(F.col("format") == fmt).select("path", "length")
        out = out.unionByName(checks[fmt](own).select("path", F.lit(fmt).alias("format"), "status", "msg"))
    return out


def probe_readable(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``path, format, status, msg`` for files of mixed formats, routed by their table.

    Hidden files and job markers are not checked. Every file has a verdict of its own: one
    that is damaged or can't be opened leaves the others alone.
    """
    listed = files.withColumn("path", one_form(F.col("path")))
    marker = is_marker(F.col("path"))
    markers = route_format(listed.where(marker), registry).select("path", "format", F.lit(1).alias("status"), F.lit(MARKER).alias("msg"))
    return check_content(listed.where(~marker), registry).unionByName(markers)
