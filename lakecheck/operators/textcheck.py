"""Field-count checks of delimited text, plain and gzip."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakecheck.functions.text import field_count, fields_ok, not_blank
from lakecheck.operators.lookup import dimension_join, with_registry
from lakecheck.sources.files import with_table
from lakecheck.sources.tables import NOT_OPENED, read_gzip_lines, read_text_lines, scan_text_rows

NO_ENTRY = "no registry entry"


def check_rows(rows: DataFrame, **tolerance: int) -> DataFrame:
    """Add ``n_fields`` and ``row_ok`` to rows with ``value, n_cols, sep``.

    Blank rows are fine whatever the table.
    """
    counted = rows.withColumn("n_fields", field_count(F.col("value"), F.col("sep")))
    verdict = fields_ok(F.col("n_fields"), F.col("n_cols"), **tolerance)
    return counted.withColumn("row_ok", verdict | ~not_blank(F.col("value")))  # good rows skip the blank test


def check_delimited(rows: DataFrame, registry: DataFrame, **tolerance: int) -> DataFrame:
    """Join text rows (``path, value, ..``) with their table's layout and check each row."""
    return check_rows(with_registry(with_table(rows), registry), **tolerance)


def check_text_tables(spark: SparkSession, layouts: Sequence[tuple[str, int | None, str | None]], **tolerance: int) -> DataFrame:
    """Checked rows of whole tables, given as ``(folder, n_cols, sep)``.

    Cheaper per row than :func:`check_delimited`: the layout is a constant of each scan, so
    no row has to find its table first.
    """

    def checked(n_cols: int | None, sep: str | None, folders: list[str]) -> DataFrame:
        rows = scan_text_rows(spark, *folders)
        layout = {"n_cols": F.lit(n_cols).cast("int"), "sep": F.lit(sep).cast("string")}
        return check_rows(rows.withColumns(layout), **tolerance)

    alike: dict[tuple, list[str]] = {}
    for folder, n_cols, sep in layouts:  # one scan for each distinct layout
        alike.setdefault((n_cols, sep), []).append(folder)
    return reduce(DataFrame.unionByName, (checked(*layout, folders) for layout, folders in alike.items()))


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows of a text scan (``path, block_start, ..``) for texts that many tasks wrote: the files
    ``part-<number>..`` of a folder, one after the other by number, count as one file, named by the folder."""
    number = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("bigint")
    folder = F.regexp_extract("path", r"^(.*/)[^/]*$", 1)
    return rows.withColumns({"path": folder, "block_start": number * (1 << 43) + F.col("block_start")})  # files of up to 8 TB


def text_verdict(rows: DataFrame) -> DataFrame:
    """One verdict per file from checked rows of a text scan.

    ``path, status, msg, n_rows, n_bad, bad_fields, first_bad_line, first_bad``; status 1 if
    the table is unknown; ``bad_fields`` is the median field count of
    the bad rows in the first split that has any. Lines are counted per split first, which needs no row shuffle; their
    numbers in the file follow from the counts of the splits before. A row with ``error`` says
    that its file broke off, or couldn't be opened (status 1), and counts as no line.
    """
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    real = F.col("error").isNull()
    bad = real & ~F.col("row_ok")
    splits = rows.groupBy("path", "block_start").agg(
        F.count_if(real).alias("n"),
        F.max("error").alias("error"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(real & F.col("n_cols").isNull()).alias("n_unknown"),
        F.min("row_pos").alias("first_pos"),
        F.min(F.when(bad, F.struct("row_pos", "value"))).alias("bad"),
        # also keeps Spark on hash aggregation: a minimum of strings alone would sort all rows
        F.percentile_approx(F.when(bad, F.col("n_fields")), 0.5).alias("bad_fields"),
    )
    before = Window.partitionBy("path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    line_no = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("bad.row_pos") - F.col("first_pos") + 1
    found = F.col("bad_fields").isNotNull()  # not "bad": so the median is computed with it, see above
    numbered = splits.withColumn("first", F.when(found, F.struct(line_no.alias("line"), "bad.value")))
    files = numbered.groupBy("path").agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_bad").alias("n_bad"),
        F.sum("n_unknown").alias("n_unknown"),
        F.min("first").alias("first"),
        F.min_by("bad_fields", "first").alias("bad_fields"),
        F.max("error").alias("error"),
    )
    return _verdict(files, F.col("error"))


def _verdict(files: DataFrame, error) -> DataFrame:
    damaged = (F.col("n_bad") > 0) | error.isNotNull()
    unknown = F.col("n_unknown") > 0
    status = F.when(error.startswith(NOT_OPENED), 1).when(error.isNotNull(), -1).when(unknown, 1).when(damaged, -1).otherwise(0)
    shown = F.concat(F.lit("field count differs in line "), F.col("first.line").cast("string"))
    msg = F.coalesce(error, F.when(unknown, F.lit(NO_ENTRY)), F.when(F.col("n_bad") > 0, shown))
    return files.select(
        "path",
        status.cast("int").alias("status"),
        msg.alias("msg"),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.when(unknown, 0).otherwise(F.col("n_bad")).cast("bigint").alias("n_bad"),
        F.when(~unknown, F.col("bad_fields")).alias("bad_fields"),
        F.when(~unknown, F.col("first.line")).cast("bigint").alias("first_bad_line"),
        F.when(~unknown, F.col("first.value")).alias("first_bad"),
    )


def check_gzip_delimited(files: DataFrame, registry: DataFrame, **tolerance: int) -> DataFrame:
    """The same verdict for gzip text files, given by ``path``; a broken stream is damage, one
    that can't be opened is not checked."""
    lines = read_gzip_lines(files)
    checked = check_delimited(lines, registry, **tolerance)
    real = F.col("line_no").isNotNull()
    bad = real & ~F.col("row_ok")
    every = files.select("path").distinct()
    first = F.min(F.when(bad, F.struct(F.col("line_no").alias("line"), "value")))
    median = F.percentile_approx(F.when(bad, F.col("n_fields")), 0.5)  # see text_verdict
    per_file = checked.groupBy("path").agg(
        F.count_if(real).alias("n_rows"),
        F.count_if(bad).alias("n_bad"),
        F.count_if(real & F.col("n_cols").isNull()).alias("n_unknown"),
        F.when(median.isNotNull(), first).alias("first"),
        median.alias("bad_fields"),
        F.max("error").alias("error"),
    )
    complete = every.join(per_file, "path", "left").fillna(0, ["n_rows", "n_bad", "n_unknown"])
    return _verdict(complete, F.col("error")).drop("error")


def check_text_files(files: DataFrame, registry: DataFrame, **tolerance: int) -> DataFrame:
    """The same verdict for text files given by ``path, length``, plain or compressed, one row
    each: a file that can't be read says so and leaves the others alone."""
    rows = check_delimited(read_text_lines(files), registry, **tolerance)
    found = files.select("path").distinct().join(text_verdict(rows), "path", "left")
    return found.withColumn("status", F.coalesce("status", F.lit(0))).fillna(0, ["n_rows", "n_bad"])
