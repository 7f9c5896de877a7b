"""Storage logs -> events. The parser is stateless and also takes a streaming frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions import logs


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a day's logs; split size is ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def tag_lines(lines: DataFrame) -> DataFrame:
    """Every line that is not noise, with its fields and a ``reason`` if it is unusable.

    The fields come out of a one-element array, so that a filter on them does not make
    Spark evaluate their expressions a second time below the filter.
    """
    line = F.col("value")
    kind = logs.event_type(line)
    fields = F.struct(
        kind.alias("event_type"),
        logs.event_host(line).alias("host"),
        logs.block_id(line, kind).alias("block_id"),
        logs.event_time(line).alias("event_time"),
    )
    reason = (
        F.when(F.col("event_type").isNull(), "no event type")
        .when(F.col("block_id").isNull(), "no block")
        .when(F.col("event_time").isNull(), "no time")
    )
    tagged = lines.where(logs.is_signal(line)).select(line, F.inline(F.array(fields)))
    return tagged.withColumn("reason", reason)


def parse_events(lines: DataFrame) -> DataFrame:
    """Usable events: ``event_type, host, block_id, event_time, dt``."""
    return tag_lines(lines).where("reason is null").select(
        "event_type", "host", "block_id", "event_time", F.to_date("event_time").alias("dt")
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Lines that look like log lines but give no event: ``value, reason``."""
    return tag_lines(lines).where("reason is not null").select("value", "reason")
