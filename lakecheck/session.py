"""Session settings, the shared scratch folder, and size-checked broadcasts."""

from __future__ import annotations

import math
import shutil
import tempfile
import uuid
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job of this package wants; all are safe to change per cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # log lines and text tables are scanned in large splits, small files are packed
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.files.openCostInBytes": "1m",
    # a listing of millions of files needs no million tasks
    "spark.sql.files.maxPartitionNum": "50000",
    # text checks keep a few numbers per split; a task of packed small files has many splits
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # one damaged byte in an uncompressed page is only seen with page checksums
    "spark.hadoop.parquet.page.verify-checksum.enabled": "true",
}


def build_session(app_name: str = "lakecheck", master: str | None = None, **extra: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``extra`` uses ``_`` for the dots of a key."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers, as ``--py-files``
    would; once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        base = Path(tempfile.mkdtemp(prefix="lakecheck-")) / here.name
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", here.parent, here.name))
        _shipped.add(app)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="lakecheck-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder of ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a cluster the
    executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/lakecheck/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, runs
    the plan a single time and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Measure a candidate for broadcasting; reads at most ``max_rows + 1`` rows."""
    width = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(1)) for c in df.columns), F.lit(0)
    )
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum(width).alias("b")).first()
    return seen["n"] <= max_rows and (seen["b"] or 0) <= max_bytes


def tasks_for(files: DataFrame, bytes_per_task: int, files_per_task: int = 1, most: int = 100_000) -> int:
    """Tasks for work on a listing: by its total ``length``, and no more than one per
    ``files_per_task`` files (0: no such bound, for work that is cut finer than files).
    Reads metadata only; without a ``length`` column the shuffle setting decides."""
    spark = files.sparkSession
    if "length" not in files.columns:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = files.agg(F.count("*").alias("n"), F.sum("length").alias("b")).first()
    wanted = max(spark.sparkContext.defaultParallelism, math.ceil((total["b"] or 0) / bytes_per_task))
    if files_per_task:
        wanted = min(wanted, math.ceil(total["n"] / files_per_task))
    return max(1, min(wanted, most))
