"""Joins of facts with dimensions, block maps, results and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.functions import paths
from lakecheck.session import fits_broadcast

DEFAULT_FORMAT = "orc"  # fixed value: format of tables without an entry
SALTS = 32


def dimension_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """``left`` with a dimension; ``how``: left (then unique per ``key``), left_semi, left_anti.

    The dimension is measured first. A small one is broadcast. A larger one is joined by
    shuffle with the left side salted, because few keys may hold most of its rows.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), key, how)
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1))))
    return left.withColumn("_salt", salt).join(copies, [key, "_salt"], how).drop("_salt")


def with_registry(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``format, n_cols, sep`` of the file's table; null for unknown tables."""
    return dimension_join(files, registry.select("table", "format", "n_cols", "sep"), "table", "left")


def route_format(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Like :func:`with_registry`, with the default format for unknown tables."""
    routed = with_registry(files, registry)
    return routed.withColumn("format", F.coalesce("format", F.lit(DEFAULT_FORMAT)))


def route_by_prefix(files: DataFrame, prefixes: list[str]) -> DataFrame:
    """Add ``format``: parquet below one of the prefixes, else the default."""
    hit = paths.starts_with_any(F.col("path"), prefixes)
    return files.withColumn("format", F.when(hit, "parquet").otherwise(DEFAULT_FORMAT))


def route_by_prefixes(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``format``: that of the longest prefix of the path in ``prefixes`` (``prefix, format``,
    each prefix once), else the default.

    Any number of prefixes: a path is looked up by equality, once for each length that a prefix
    has, so there is no chain of tests and no list of prefixes on the driver, which gets
    their lengths alone (no more than the longest path has characters).
    """
    lengths = sorted(r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect() if r["n"] is not None)
    if not lengths:
        return files.withColumn("format", F.lit(DEFAULT_FORMAT))
    tried = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    starts = files.select("path").distinct().select("path", F.explode(F.transform(tried, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    hits = dimension_join(starts, prefixes.select("prefix", "format"), "prefix", "left").where("format is not null")
    best = hits.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "format")).alias("_best"))
    routed = files.join(best, "path", "left").withColumn("format", F.coalesce("_best.format", F.lit(DEFAULT_FORMAT)))
    return routed.select(*files.columns, "format")


def exclude_databases(files: DataFrame, databases: DataFrame) -> DataFrame:
    """Drop files whose ``db`` is listed (exact match)."""
    return dimension_join(files, databases.select("db"), "db", "left_anti")


def exclude_prefixes(df: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop rows whose path starts with a listed pair of components (``a/b`` of ``/a/b/c``).

    Rows without a path stay.
    """
    listed = exclusions.select(F.col("prefix").alias("_prefix"))
    keyed = df.withColumn("_prefix", paths.prefix_key(F.col("path")))
    return dimension_join(keyed, listed, "_prefix", "left_anti").drop("_prefix")


def blocks_to_files(blocks: DataFrame, block_map: DataFrame) -> DataFrame:
    """Add ``path, hosts`` to distinct ``block_id`` rows; null if the block is unknown.

    A plain join: the map is the huge side, and Spark can thin it out with a Bloom filter
    of the blocks before the shuffle.
    """
    return blocks.join(block_map.select("block_id", "path", "hosts"), "block_id", "left")


def with_file_status(blocks: DataFrame, results: DataFrame) -> DataFrame:
    """Add the ``status`` of the block's file. A file is checked once, not once per block.
    Blocks without a file, which may be many, take no part in the join."""
    status = results.select("path", "status")
    joined = blocks.where("path is not null").join(status, "path", "left")
    unknown = blocks.where("path is null").withColumn("status", F.lit(None).cast(status.schema["status"].dataType))
    return joined.unionByName(unknown)


def pending(work: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Work that has no finished entry yet."""
    return work.join(done.select(key), key, "left_anti")
