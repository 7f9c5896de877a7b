"""Writers. Folders take the place of single files, so that no table, day or shard has
to pass through one task: ``rebalance`` lets Spark split the large ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions.messages import report_line
from lakecheck.session import materialize


def _by_partition(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together in few files; hot keys are split at run time."""
    return df.hint("rebalance", *map(F.col, keys))


def _replacing(df: DataFrame) -> DataFrameWriter:
    """Of a whole table: partitions of an earlier run go, whatever the session's setting."""
    return df.write.mode("overwrite").option("partitionOverwriteMode", "static")


def write_manifests(files: DataFrame, out: str) -> None:
    """One manifest folder ``db=../table=..`` per table; ``files`` has ``db, table, path``."""
    rows = files.select("db", "table", F.col("path").alias("value"))
    _replacing(_by_partition(rows, "db", "table")).partitionBy("db", "table").text(out)


def is_complete(spark: SparkSession, out: str) -> bool:
    """Whether a report was written to its end: its summary comes last."""
    try:
        return spark.read.text(f"{out}/summary/_SUCCESS").isEmpty()
    except AnalysisException:
        return False


def write_check_report(results: DataFrame, out: str, redo: bool = False) -> bool:
    """``out/damaged`` with ``path===msg`` lines of status -1 and ``out/summary`` with one
    row ``n_checked, n_bad, n_unchecked``. A finished report is left as it is, before any
    check runs, unless ``redo``; says whether it was written. Output without a summary is
    unfinished and replaced. The checks run once: their rows are kept in the shared folder
    for both outputs."""
    if not redo and is_complete(results.sparkSession, out):
        return False
    results = materialize(results, "results")
    damaged = results.where("status = -1").select(report_line(F.col("path"), F.col("msg")).alias("value"))
    damaged.write.mode("overwrite").text(f"{out}/damaged")
    report_summary(results).write.mode("overwrite").parquet(f"{out}/summary")
    return True


def report_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") != 1).alias("n_checked"),
        F.count_if(F.col("status") == -1).alias("n_bad"),
        F.count_if(F.col("status") == 1).alias("n_unchecked"),
    )


def write_events(events: DataFrame, out: str) -> None:
    """CSV below ``dt=`` folders; replaces the days that are written, keeps the others."""
    rows = events.select("event_type", "host", "block_id", "event_time", "dt")
    (
        _by_partition(rows, "dt")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .partitionBy("dt")
        .csv(out)
    )


NO_PATH = "fpNull"  # fixed value: stands for a missing path in the CSV files


def block_status_rows(status: DataFrame) -> DataFrame:
    """``block_id, path, hosts, status, checked_at`` as CSV columns."""
    return status.select(
        "block_id",
        F.coalesce("path", F.lit(NO_PATH)).alias("path"),
        F.array_join("hosts", "_").alias("hosts"),
        "status",
        F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("checked_at"),
    )


def write_block_status(status: DataFrame, out: str) -> bool:
    """CSV of the checked blocks; writes nothing if there are none, and says so."""
    rows = materialize(block_status_rows(status), "status")
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").csv(out)
    return True


def write_block_map(block_map: DataFrame, out: str) -> None:
    """``block_id,path`` CSV."""
    rows = block_map.select("block_id", F.coalesce("path", F.lit(NO_PATH)).alias("path"))
    rows.write.mode("overwrite").csv(out)


def write_shards(df: DataFrame, out: str, value: str = "value") -> None:
    """Text below ``shard=`` folders; ``df`` has ``shard`` and the line column."""
    rows = df.select("shard", F.col(value).cast("string").alias("value"))
    _replacing(_by_partition(rows, "shard")).partitionBy("shard").text(out)


def write_compressed(lines: DataFrame, out: str, codec: str = "gzip") -> None:
    """Compressed text, one file per partition of ``lines``; replaces earlier output."""
    lines.select("value").write.mode("overwrite").option("compression", codec).text(out)


_POINTERS = "seq bigint, path string"


def publish(df: DataFrame, out: str, write: Callable[[DataFrame, str], object]) -> str:
    """Write a new version of an output below ``out`` with one of the writers above, then point to
    it. Until the pointer is there, a row that Spark commits as a whole, readers get the
    version before; a run that dies leaves that one as it was. Earlier versions stay, for
    readers that have begun; remove them when none has."""
    spark = df.sparkSession
    version = f"{out.rstrip('/')}/versions/{uuid.uuid4().hex}"
    write(df, version)
    seq = max((r["seq"] for r in _pointers(spark, out)), default=0) + 1
    spark.createDataFrame([(seq, version)], _POINTERS).coalesce(1).write.mode("append").parquet(f"{out.rstrip('/')}/pointers")
    return version


def published(spark: SparkSession, out: str) -> str | None:
    """The folder of the version that was published last, if there is one."""
    last = max(((r["seq"], r["path"]) for r in _pointers(spark, out)), default=None)
    return last and last[1]


def _pointers(spark: SparkSession, out: str) -> list[Row]:
    try:
        return spark.read.schema(_POINTERS).parquet(f"{out.rstrip('/')}/pointers").orderBy(F.desc("seq"), F.desc("path")).limit(1).collect()
    except AnalysisException:  # nothing was published yet
        return []


def keep_recent(df: DataFrame, today: str, days: int = 3) -> DataFrame:
    """Rows whose ``dt`` is less than ``days`` days old; prunes partitions of a ``dt=`` table."""
    return df.where(F.col("dt") > F.date_sub(F.lit(today).cast("date"), days))
