"""Storage logs -> blocks with trouble -> files -> status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.operators.aggregates import distinct_blocks
from lakecheck.operators.lookup import blocks_to_files, exclude_prefixes, with_file_status
from lakecheck.sources.logs import parse_events


def damaged_files(
    lines: DataFrame, block_map: DataFrame, exclusions: DataFrame, results: DataFrame
) -> DataFrame:
    """``block_id, path, hosts, status, checked_at`` of every block named in the logs.

    Blocks are made distinct before they meet the block map, and files are checked once
    however many of their blocks are named. Unknown blocks keep an empty path.
    """
    blocks = distinct_blocks(parse_events(lines))
    located = exclude_prefixes(blocks_to_files(blocks, block_map), exclusions)
    return with_file_status(located, results).select(
        "block_id", "path", "hosts", "status", F.current_timestamp().alias("checked_at")
    )
