"""Exact dedup: a tree merge of digest runs, DataFrame functions only.

Every scan partition is a *run* of rows with a digest. Runs are merged in rounds: in round
r the runs whose numbers agree above the lowest ``r * fan_bits`` bits meet in one, so each
round divides the number of runs by ``2 ** fan_bits``. A merged run keeps, for each digest,
the identifier that stays and the number of rows, and nothing else. Then the outcome
goes down to the first runs and from there to the rows. No task sees more rows of one
digest than a run has, or than there are runs below a merge, however many copies exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.registry import ORACLES, query, table
from lakecheck.session import fits_broadcast, materialize

#: A merge takes 2 ** FAN_BITS runs. Digests are compared together with length and a second hash.
FAN_BITS = 5
KEY = ["_digest", "_bytes", "_check"]


def with_digest(docs: DataFrame, text: Column) -> DataFrame:
    """Adds the run, the row's number and what identifies its text."""
    text = F.coalesce(text, F.lit(""))
    return docs.withColumns({
        "_row": F.monotonically_increasing_id(),
        "_digest": F.unhex(F.sha2(text, 256)),
        "_bytes": F.octet_length(text),
        "_check": F.xxhash64(text),
    }).withColumn("_run", F.shiftright("_row", 33))


def _merged(runs: DataFrame, bits: int, keep: str) -> DataFrame:
    """One round: runs with equal higher bits become one."""
    by, best = (F.max_by, F.max) if keep == "max" else (F.min_by, F.min)
    return runs.groupBy(F.shiftright("_run", bits).alias("_run"), *KEY).agg(
        best("_keep").alias("_keep"),
        F.coalesce(by("_keep_row", "_keep"), F.min("_keep_row")).alias("_keep_row"),
        F.sum("_n").alias("_n"),
    )


def merge_runs(numbered: DataFrame, id_col: str = "doc_id", keep: str = "min", fan_bits: int = FAN_BITS) -> DataFrame:
    """``_run, _digest, _bytes, _check`` of the first runs with the merged ``_keep`` (identifier
    that stays), ``_keep_row`` (its row) and ``_n`` (rows), for texts that occur more than once.

    ``numbered`` is a written table (see :func:`with_digest`), so that rows keep their numbers.
    """
    rows = numbered.select("_run", *KEY, F.col(id_col).alias("_keep"), F.col("_row").alias("_keep_row"), F.lit(1).cast("long").alias("_n"))
    first = materialize(_merged(rows, 0, keep), "runs")
    top = first.agg(F.max("_run")).first()[0] or 0
    level, reached = first, 0
    while top >> reached:
        reached += fan_bits
        level = _merged(level, fan_bits, keep)
    several = level.where("_n > 1").drop("_run")
    # a text has one row for each run here, at most as many as the table has partitions
    return first.select("_run", *KEY).join(several, KEY)


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` says whether the smallest or the largest identifier of equal texts stays. Null
    text is the empty text. A null identifier stays only if its group has no other. Of rows
    with the same text and the same identifier one stays. No rows in: no rows out. Other
    columns are not read, whatever they are called.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(with_digest(slim, F.col("text")).drop("text"), "digests")
    merged = merge_runs(rows, "doc_id", keep)
    return rows.join(merged, ["_run", *KEY], "left").select(
        "doc_id",
        F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep_row") == F.col("_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """``docs`` with one row of each text, all columns as they were; see :func:`exact_groups`."""
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    rows = materialize(with_digest(named, F.col(f"_doc.`{text_col}`")), "numbered")
    merged = merge_runs(rows.select("_run", *KEY, "_row", F.col(f"_doc.`{id_col}`").alias("_id")), "_id", keep)
    gone = materialize(rows.select("_run", *KEY, "_row").join(merged, ["_run", *KEY]).where("_row <> _keep_row").select("_row"), "copies")
    left = rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "_row", "left_anti")
    return left.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


@query
def op4_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
