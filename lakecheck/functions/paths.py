"""Warehouse paths: parts, roots, names of manifests and repair targets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)?"


def _quoted(roots: Sequence[str]) -> str:
    # longest first, so that a root never hides a longer one
    return "|".join(rf"\Q{r.rstrip('/')}\E" for r in sorted(roots, key=len, reverse=True))


def one_form(path: Column) -> Column:
    """The form in which Spark lists a path: ``file:/a`` for ``/a`` and ``file:///a``. Listings
    and scans of all sources use it, so that their paths can be joined."""
    local = F.when(path.startswith("file:/"), F.regexp_replace(path, "^file:/+", "file:/")).when(path.startswith("/"), F.concat(F.lit("file:"), path))
    return F.coalesce(local, path)


def is_marker(path: Column) -> Column:
    """Names that start with ``_`` or ``.``: no content of a table."""
    return F.substring_index(path, "/", -1).rlike(r"^[_.]")


def db_name(path: Column) -> Column:
    """``b`` of ``/a/b.db/t/...``, null if the path has no ``.db`` part."""
    return F.when(path.contains(".db/"), F.substring_index(F.substring_index(path, ".db/", 1), "/", -1))


def table_name(path: Column) -> Column:
    """``t`` of ``/a/b.db/t/...``, null if the path has no ``.db`` part. No regex: text
    scans call it once per row."""
    below = F.substring_index(F.substring_index(path, ".db/", 2), ".db/", -1)
    return F.when(path.contains(".db/"), F.substring_index(below, "/", 1))


def path_component(path: Column, n: int) -> Column:
    """The n-th part between slashes (0 is before the first slash); null if there is none."""
    return F.get(F.split(path, "/"), F.lit(n))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(path: Column, roots: Sequence[str]) -> Column:
    """Remove one leading warehouse root, with or without scheme and host in front of it."""
    return F.regexp_replace(path, rf"{_AUTHORITY}(?:{_quoted(roots)})/", "")


def absolute_path(path: Column, root: str) -> Column:
    """Prepend the root unless the path already starts with it."""
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), path).otherwise(F.concat(F.lit(root + "/"), path))


def manifest_name(table_dir: Column, roots: Sequence[str]) -> Column:
    """``/root/b.db/t`` -> ``b_db_t``."""
    return F.replace(relative_path(table_dir, roots), F.lit(".db/"), F.lit("_db_"))


# Suffix of the warehouse root that receives repaired files.
TARGET_SUFFIX = {"orc": "_repl", "parquet": "_repl", "text": "_text", "text_gzip": "_text"}


def target_path(path: Column, fmt: Column, root: str) -> Column:
    """Where the repaired copy goes; null for a format without a target."""
    root = root.rstrip("/")
    anchored = rf"^\Q{root}\E/"
    cases = reduce(
        lambda chain, item: chain.when(fmt == item[0], F.regexp_replace(path, anchored, f"{root}{item[1]}/")),
        TARGET_SUFFIX.items(),
        F,
    )
    return cases.otherwise(F.lit(None))


def prefix_key(path: Column) -> Column:
    """First two components (``a/b`` of ``/a/b/c``); null for paths of two parts or fewer."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.concat_ws("/", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def starts_with_any(path: Column, prefixes: Sequence[str]) -> Column:
    """True if the path starts with one of the prefixes (all of them are tested)."""
    return reduce(lambda a, b: a | b, (path.startswith(p) for p in prefixes), F.lit(False))
