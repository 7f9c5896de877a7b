"""Line-oriented inputs: manifests, block lists, event files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions.text import java_trim, not_blank

EVENT_SCHEMA = "event_type string, host string, block_id bigint, event_time timestamp, dt date"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path)


def clean_lines(lines: DataFrame) -> DataFrame:
    """Trimmed, non-blank ``value`` rows. The first line counts like any other."""
    return lines.where(not_blank(F.col("value"))).select(java_trim(F.col("value")).alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One path per line -> ``path``."""
    return clean_lines(_lines(spark, path)).withColumnRenamed("value", "path")


def read_block_ids(spark: SparkSession, path: str) -> DataFrame:
    """One block number per line, with or without ``blk_`` -> ``block_id``."""
    return parse_block_ids(_lines(spark, path))


def parse_block_ids(lines: DataFrame) -> DataFrame:
    number = F.regexp_replace(F.col("value"), "^blk_", "").try_cast("bigint")
    return clean_lines(lines).select(number.alias("block_id")).where("block_id is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event files as written by :func:`lakecheck.sources.sinks.write_events`."""
    return spark.read.schema(EVENT_SCHEMA).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def read_error_report(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path)
