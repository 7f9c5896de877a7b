"""The file inventory: every file below a warehouse root as one row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions import paths
from lakecheck.session import materialize
from lakecheck.sources.tables import list_folder, trouble


def scan_files(spark: SparkSession, *roots: str) -> DataFrame:
    """``path, length, modification_time, db, table`` of all files below the roots.

    Only metadata is read: the content column is pruned from the scan. Spark's listing
    leaves out hidden files (``_*``, ``.*``) and empty ones; see :func:`scan_all_files`.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(list(roots))
        .select(paths.one_form(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modification_time"))
    )
    return with_table(found)


LISTING_SCHEMA = "path string, length bigint, modification_time timestamp, is_dir boolean, error string"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.bool_(), pa.string())

    def rows(found: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["path", "length", "modification_time", "is_dir", "error"])

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            try:
                for page in list_folder(folder):
                    yield rows([(*entry, None) for entry in page])
            except OSError as problem:
                yield rows([(folder, None, None, True, trouble(problem))])


def list_all(spark: SparkSession, *roots: str) -> tuple[DataFrame, DataFrame]:
    """The inventory including hidden, marker and empty files, and ``path, error`` of the folders
    that could not be listed: missing, refused, or broken off half-way.

    Folders are listed in tasks, one level of the tree per job; a level is written to the
    shared folder before the next, so the number of jobs is the depth of the tree.
    """
    levels, folders = [], spark.createDataFrame([(r,) for r in roots], "path string").select(paths.one_form(F.col("path")).alias("path"))
    tasks = spark.sparkContext.defaultParallelism * 4
    while True:
        spread = folders.select("path").repartition(tasks, "path")
        level = materialize(spread.mapInArrow(_list_folders, LISTING_SCHEMA), "listing")
        levels.append(level)
        folders = level.where("is_dir AND error IS NULL")
        if folders.isEmpty():
            every = reduce(DataFrame.unionByName, levels)
            return with_table(every.where("NOT is_dir").drop("is_dir", "error")), every.where("error IS NOT NULL").select("path", "error")


def scan_all_files(spark: SparkSession, *roots: str) -> DataFrame:
    """The inventory of :func:`list_all`, where every folder must be listed: otherwise raises
    ``OSError``, as files that were not seen would pass for files that don't exist."""
    found, unlisted = list_all(spark, *roots)
    if missed := unlisted.first():
        raise OSError(f"{missed['path']}: {missed['error']}")
    return found


def with_table(files: DataFrame) -> DataFrame:
    """Add ``db`` and ``table`` from the path."""
    return files.withColumns(
        {"db": paths.db_name(F.col("path")), "table": paths.table_name(F.col("path"))}
    )


def list_tables(files: DataFrame) -> DataFrame:
    """Distinct ``db, table`` pairs."""
    return files.select("db", "table").distinct()
