"""Storage-log lines: noise, event type, block, host, time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakecheck.functions.text import java_trim, not_blank

# Marker in a line -> event type, in order of precedence.
EVENT_MARKERS = {
    "InvalidDecodingException": "invalidDecoding",
    "EC reconstruct striped": "reconstruct",
    "Failed to reconstruct": "failed",
}
# Notice for an unreadable input, host marker, end of the host, time format.
NOISE_MARKER = "Binary file"
HOST_MARKER = "-datanode-"
HOST_END = ".com.log"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def is_signal(line: Column) -> Column:
    """Neither blank nor a notice about a binary file."""
    return not_blank(line) & ~line.contains(NOISE_MARKER)


def event_type(line: Column) -> Column:
    """Type of the first marker in precedence order, null for other lines."""
    chain = F
    for marker, name in EVENT_MARKERS.items():
        chain = chain.when(line.contains(marker), F.lit(name))
    return chain.otherwise(F.lit(None).cast("string"))


def block_id(line: Column, kind: Column) -> Column:
    """Block number: after ``blockId:`` for a reconstruction, else after the first ``blk_``."""
    announced = F.regexp_extract(line, r"blockId:\s*(?:blk_)?(-?\d+)", 1)
    named = F.regexp_extract(line, r"blk_(-?\d+)", 1)
    digits = F.when(kind == "reconstruct", announced).when(kind.isNotNull(), named)
    return F.nullif(digits, F.lit("")).try_cast("bigint")  # casting '' would cost an exception


def event_host(line: Column) -> Column:
    """Host between the marker and the log suffix; null unless the marker is there once."""
    head = F.substring_index(line, HOST_END, 1)
    once = F.length(head) - F.length(F.replace(head, F.lit(HOST_MARKER), F.lit(""))) == len(HOST_MARKER)
    host = java_trim(F.substring_index(head, HOST_MARKER, -1))
    return F.when(once & (host != ""), F.concat(host, F.lit(".com")))


def event_time(line: Column) -> Column:
    """Timestamp that follows the colon of the first ``:202``, null if it does not parse."""
    at = F.locate(":202", line)
    written = F.substring(line, at + 1, F.lit(len("yyyy-MM-dd HH:mm:ss")))
    return F.when(at > 0, F.try_to_timestamp(written, F.lit(TIME_FORMAT)))


def short_host(host: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """Cut everything after ``com/`` and drop the configured prefix and domain suffixes."""
    cut = F.substring_index(host, "com/", 1)
    out = java_trim(F.when(host.contains("com/"), F.concat(cut, F.lit("com"))).otherwise(host))
    for names, anchored in ((suffixes, "(?:{})$"), (prefixes, "^(?:{})")):
        if names:
            out = F.regexp_replace(out, anchored.format("|".join(rf"\Q{n}\E" for n in names)), "")
    return out
