"""Rewrite a text table compressed and in fewer files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakecheck.operators.aggregates import dir_size
from lakecheck.operators.compaction import RATIO, compact_text, compaction_files, line_fingerprint
from lakecheck.sources.files import scan_files
from lakecheck.sources.sinks import write_compressed
from lakecheck.sources.tables import scan_small_text


class Compaction(NamedTuple):
    """``whole``: the output was read back and holds each line as often as the input."""

    n_files: int
    n_lines: int
    whole: bool


#: Bytes of lines that one task sorts and writes: a file is written by one task.
TASK_BYTES = 256 << 20


def compact_table(spark: SparkSession, source: str, out: str, codec: str = "gzip", ratio: int = RATIO, task_bytes: int = TASK_BYTES) -> Compaction:
    """Write the lines of ``source`` to ``out`` and prove that nothing was lost or doubled: a
    fingerprint that depends on neither order nor files is taken of both, by one more scan
    of each. A task writes one file, so there are as many as hold ``task_bytes`` of lines each,
    even if the codec's target size asks for fewer."""
    size = dir_size(scan_files(spark, source))
    wanted = F.greatest(compaction_files(F.col("n_bytes"), codec, ratio), F.ceil(F.col("n_bytes") / task_bytes).cast("bigint"))
    n_files = size.select(wanted.alias("n")).first()["n"]
    write_compressed(compact_text(scan_small_text(spark, source), n_files), out, codec)
    before, after = (line_fingerprint(scan_small_text(spark, path)).first() for path in (source, out))
    return Compaction(n_files, after["n_lines"], before == after)
