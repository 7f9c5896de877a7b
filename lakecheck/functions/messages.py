"""Check messages and the report lines made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator between path and message; wording of the parity message.
REPORT_SEPARATOR = "==="
MISMATCH = "EC compute result not match."
UNDER_CODED = "Block group is under-erasure-coded."


def mismatch_message(host: Column, block: Column) -> Column:
    return F.concat(
        F.lit(f"Status: ERROR, message: {MISMATCH}:ip is "),
        F.coalesce(host, F.lit("")),
        F.lit(" block is : "),
        F.coalesce(block.cast("string"), F.lit("")),
    )


def report_line(path: Column, msg: Column) -> Column:
    return F.concat_ws(REPORT_SEPARATOR, path, msg)


def reported_path(line: Column) -> Column:
    return F.substring_index(line, REPORT_SEPARATOR, 1)


def suspect_host(msg: Column) -> Column:
    """Host named between ``ip is`` and ``block is``; null if there is none."""
    found = F.regexp_extract(msg, r"ip is\s*(\S+)\s*block is", 1)
    return F.when(found != "", found)
