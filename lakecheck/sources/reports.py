"""Captured block reports -> block map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.logs import short_host
from lakecheck.functions.text import java_trim

# The two kinds of report lines that carry facts.
OWNER_MARKER = "Block belongs to:"
REPLICA_MARKER = "Block replica on datanode/rack"


def parse_block_report(
    lines: DataFrame, host_prefixes: Sequence[str] = (), host_suffixes: Sequence[str] = ()
) -> DataFrame:
    """``block_id, value`` report lines -> ``block_id, path, hosts``.

    Hosts are a sorted set, so that repeated reports of one block stay as small as the
    cluster's host list; both aggregates combine before the shuffle.
    """
    line = F.col("value")
    path = F.when(line.startswith(OWNER_MARKER), java_trim(F.replace(line, F.lit(OWNER_MARKER), F.lit(""))))
    replica = F.ltrim(F.substring(line, F.lit(len(REPLICA_MARKER) + 1), F.length(line)), F.lit(":"))
    host = F.when(line.startswith(REPLICA_MARKER), short_host(replica, host_prefixes, host_suffixes))
    return (
        lines.where(line.startswith(OWNER_MARKER) | line.startswith(REPLICA_MARKER))
        .select("block_id", F.nullif(path, F.lit("")).alias("path"), host.alias("host"))
        .groupBy("block_id")
        .agg(F.max("path").alias("path"), F.array_sort(F.collect_set("host")).alias("hosts"))
    )
