"""Aggregations over the fact tables; all combine before their shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.text import words


def distinct_blocks(events: DataFrame) -> DataFrame:
    return events.select("block_id").where("block_id is not null").distinct()


def word_count(lines: DataFrame, column: str = "value") -> DataFrame:
    """``word, n``; a frequent word is added up in every map task first."""
    tokens = lines.select(F.explode(words(F.col(column))).alias("word"))
    return tokens.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def dir_size(files: DataFrame, *by: str) -> DataFrame:
    """``n_bytes, n_files``, in total or per group."""
    return files.groupBy(*by).agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"), F.count("*").alias("n_files")
    )


def rows_per_file(rows: DataFrame) -> DataFrame:
    """Row count of every file of a scan. Only counts: it proves no file readable."""
    return rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"))


def manifest_counts(blocks: DataFrame, column: str) -> DataFrame:
    """``n_lines, n_distinct`` of a list."""
    return blocks.agg(F.count("*").alias("n_lines"), F.countDistinct(column).alias("n_distinct"))


def alert(status: DataFrame) -> DataFrame:
    """One row ``n_alerts, raise``: blocks of files that are damaged or could not be checked.

    Blocks without a path were never checked and raise nothing.
    """
    hit = (F.col("status") != 0) & F.col("path").isNotNull()
    return status.agg(F.count_if(hit).alias("n_alerts"), (F.count_if(hit) > 0).alias("raise"))


def sort_events(events: DataFrame) -> DataFrame:
    """Total order by type, then block."""
    return events.orderBy("event_type", "block_id")

