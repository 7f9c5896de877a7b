"""Global row numbers and the shards cut from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def with_row_index(df: DataFrame, *order_by: str, partitions: int | None = None) -> DataFrame:
    """Add ``idx`` (0-based position in the given order) and ``n_total``.

    Rows are range-partitioned and sorted, then written once, so that positions stay the
    same even if an executor is lost. Each partition needs only the row counts of those
    before it; no window or sort runs in a single task. A hash of the row and its
    place in the input break ties, so that one frequent key, and equal rows too, spread over
    partitions. Equal rows are interchangeable.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    keys = [F.col(c) for c in order_by] + [F.xxhash64(*df.columns), F.col("_place")]
    ranged = placed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_place")
    fixed = materialize(ranged.withColumn("_pos", F.monotonically_increasing_id()), "ranged")

    part = F.shiftright("_pos", _ROW_BITS)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # at most n rows
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias("n_total"),
    )
    row = F.col("_pos").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        fixed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_offset") + row).alias("idx"), "n_total")
    )


def shard_even(df: DataFrame, *order_by: str, k: int = 7) -> DataFrame:
    """Add ``shard``: k shards of ``n div k`` rows, and shard k with the remainder.

    With fewer than k rows all of them are the remainder.
    """
    size = F.expr(f"n_total div {k}")
    shard = F.when(size == 0, k).otherwise(F.least(F.expr(f"idx div greatest(n_total div {k}, 1)"), F.lit(k)))
    indexed = with_row_index(df, *order_by)
    return indexed.withColumn("shard", shard.cast("int")).drop("n_total")


def shard_fixed(df: DataFrame, *order_by: str, size: int = 2000) -> DataFrame:
    """Add ``shard``: 1 for the first ``size`` rows, 2 for the next, and so on."""
    indexed = with_row_index(df, *order_by)
    return indexed.withColumn("shard", F.expr(f"idx div {size} + 1").cast("int")).drop("n_total")
