"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLOTS = 1 << 40


def hash_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most ``n`` rows of ``df``, chosen by a hash of ``keys``: the same ones whatever the
    partitioning. The rows are counted first, and all but about ``2 * n`` of them fall to a
    threshold of the hash where they lie, so that what the last step brings together doesn't
    grow with the number of partitions. ``df`` is read twice."""
    total, place = df.count(), F.xxhash64(*keys)
    if total > 2 * n:
        df = df.where(F.pmod(place, F.lit(_SLOTS)) < int(2 * n / total * _SLOTS) + 1)
    return df.orderBy(place, *keys).limit(n)
