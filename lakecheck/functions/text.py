"""String rules of the delimited text files and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that a blank line may consist of (white space of the JVM,
# without the no-break spaces) and characters that trimming removes (0x00 to 0x20).
_WHITE = r"\s\x1c-\x1f\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}"
_TRIMMED = "".join(map(chr, range(0x21)))


def not_blank(c: Column) -> Column:
    """True for a line with any visible character; null counts as blank."""
    return F.coalesce(c.rlike(f"[^{_WHITE}]"), F.lit(False))


def java_trim(c: Column) -> Column:
    """Strip every character up to U+0020 from both ends (Spark's ``trim``: spaces only)."""
    return F.trim(c, F.lit(_TRIMMED))


def field_count(value: Column, sep: Column) -> Column:
    """Number of fields after dropping trailing empty ones.

    A row of separators only has 0 fields, a row without separator 1. ``sep`` may differ
    from row to row and is taken literally. One-character separators need no regex.
    """
    kept = F.rtrim(value, sep)
    seps = F.length(kept) - F.length(F.replace(kept, sep, F.lit("")))
    short = F.when((kept == "") & (value != ""), F.lit(0)).otherwise(seps + 1)
    parts = F.split(value, F.concat(F.lit(r"\Q"), sep, F.lit(r"\E")), -1)
    filled_from_end = F.array_position(F.transform(F.reverse(parts), lambda x: x != ""), True)
    long = F.when(value == "", F.lit(1)).when(filled_from_end == 0, F.lit(0)).otherwise(
        F.size(parts) - filled_from_end + 1
    )
    return F.when(F.length(sep) == 1, short).otherwise(long).cast("int")


def fields_ok(
    n_fields: Column, n_cols: Column, narrow_below: int = 10, narrow_missing: int = 2, wide_missing: int = 6
) -> Column:
    """Field-count rule of a table with ``n_cols`` columns.

    Narrow tables may miss up to two trailing fields and have none extra. Tables from
    ``narrow_below`` columns up may miss six, and extra fields pass.
    """
    missing = n_cols - n_fields
    return F.when(n_cols < narrow_below, missing.between(0, narrow_missing)).otherwise(missing <= wide_missing)


def split_fields(value: Column, sep: str) -> Column:
    """Fields of a row, split on the literal separator without any quoting rules."""
    return F.split(value, rf"\Q{sep}\E", -1)


def words(value: Column) -> Column:
    """Tokens between blanks, tabs, line ends and form feeds; may contain ``''`` at the ends."""
    return F.split(value, r"[ \t\n\r\f]+")
