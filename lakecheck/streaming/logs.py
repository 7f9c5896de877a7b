"""New log files as they arrive. The parser has no state, so nothing needs a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakecheck.sources.logs import parse_events


def stream_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Events of all log files below ``path``, also of those written later."""
    lines = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .text(path)
    )
    return parse_events(lines)


def append_events(events: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to a Parquet table by day; each log file is taken over exactly once."""
    return (
        events.writeStream.format("parquet")
        .partitionBy("dt")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(out)
    )
