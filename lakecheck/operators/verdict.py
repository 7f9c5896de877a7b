"""From many partial results to one status per file: -1 damaged, 0 fine, 1 not checkable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_CHECKED = "not checked"


def _fields(results: DataFrame) -> DataFrame:
    """``path, status, msg, bad_host, bad_block``; the last two are null if a check has none."""
    optional = {"bad_host": "string", "bad_block": "bigint"}
    columns = [F.col(c) if c in results.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    return results.select("path", "status", "msg", *columns)


def worst_status(*results: DataFrame) -> DataFrame:
    """``path, status, msg, bad_host, bad_block``: the worst result of each path, in the
    order -1, 0, 1. Takes groups of a file as well as results of several checks. What it
    says is the least of what the results of that status say, if any says something."""
    every = reduce(DataFrame.unionByName, map(_fields, results))
    worst = every.groupBy("path").agg(F.min("status").alias("status"))  # a number: hash aggregation
    told = every.where("msg is not null or bad_host is not null or bad_block is not null")
    details = told.groupBy("path", "status").agg(F.min(F.struct("msg", "bad_host", "bad_block")).alias("w"))
    return worst.join(details, ["path", "status"], "left").select("path", "status", "w.*")


def whole_files(groups: DataFrame) -> DataFrame:
    """One result per file from those of its block groups, of which none may be missing: damaged
    if any is, else not checked (1) if any isn't, else fine. Named is what :func:`worst_status` names."""
    unread = groups.groupBy("path").agg(F.count_if(F.col("status") == 1).alias("_unread"))
    worst = worst_status(groups).join(unread, "path")
    told = groups.where("status = 1").groupBy("path").agg(F.min("msg").alias("_msg"))
    open_ = (F.col("status") == 0) & (F.col("_unread") > 0)
    named = worst.join(told, "path", "left").withColumn("msg", F.when(open_, F.col("_msg")).otherwise(F.col("msg")))
    return named.select("path", F.when(open_, 1).otherwise(F.col("status")).cast("int").alias("status"), "msg", "bad_host", "bad_block")


def file_status(paths: DataFrame, *results: DataFrame) -> DataFrame:
    """One row per input path, whatever the checks returned; unchecked paths get status 1."""
    joined = paths.select("path").distinct().join(worst_status(*results), "path", "left")
    missing = F.col("status").isNull()
    return joined.withColumns(
        {
            "msg": F.when(missing, NOT_CHECKED).otherwise(F.col("msg")),
            "status": F.coalesce("status", F.lit(1)).cast("int"),
        }
    )


def damaged_only(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == -1)
