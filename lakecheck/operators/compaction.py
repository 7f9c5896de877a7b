"""Rewriting a text table compressed and in fewer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes per output file of each codec; bytes per compressed byte.
TARGET_BYTES = {"gzip": 512 << 20, "bzip2": 5 << 30}
RATIO = 3


def compaction_files(n_bytes: Column, codec: str = "gzip", ratio: int = RATIO) -> Column:
    """Output files for a table of ``n_bytes`` uncompressed bytes; at least one."""
    target = TARGET_BYTES.get(codec, TARGET_BYTES["gzip"])
    wanted = F.floor(F.floor(n_bytes / ratio) / target).cast("bigint")
    return F.when(n_bytes > target, F.greatest(F.lit(1).cast("bigint"), wanted)).otherwise(F.lit(1).cast("bigint"))


def compact_text(lines: DataFrame, n_files: int) -> DataFrame:
    """All lines in ``n_files`` partitions, equal and similar lines together, sorted.

    Every line stays as often as it came. The range also covers the row's position, so a
    line that makes up a third of the table is spread over a third of the files. ``lines``
    should be a scan: there the position is the same in every attempt of a task.
    """
    return (
        lines.select("value", F.monotonically_increasing_id().alias("_pos"))
        .repartitionByRange(n_files, "value", "_pos")
        .sortWithinPartitions("value")
        .select("value")
    )


def line_fingerprint(lines: DataFrame) -> DataFrame:
    """One row ``n_lines, h1, h2`` that is the same for two tables of lines if, and but for a chance
    of about 2^-128 only if, they hold the same lines equally often, in any order and any
    files: counts and sums of two 64-bit hashes, which combine before the shuffle."""
    wide = "decimal(38,0)"  # room for 10^18 lines
    return lines.agg(
        F.count("*").alias("n_lines"),
        F.coalesce(F.sum(F.xxhash64("value").cast(wide)), F.lit(0).cast(wide)).alias("h1"),
        F.coalesce(F.sum(F.xxhash64(F.lit("second"), "value").cast(wide)), F.lit(0).cast(wide)).alias("h2"),
    )
