"""Manifest -> parity of every block group -> one status per file."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.operators.parity import NOT_READ, Policy, audit_parity, audit_policies, checkable, group_verdict
from lakecheck.operators.verdict import file_status, whole_files
from lakecheck.session import fits_broadcast, materialize
from lakecheck.sources.units import scan_unit_cells, unread_groups


def audit_files(files: DataFrame, units: DataFrame, cells: DataFrame, policies: Mapping[str, Policy], screen: bool = True) -> DataFrame:
    """``path, status, msg, bad_host, bad_block``, one row per file.

    ``files``: ``path, exists, is_file, is_closed, policy, length`` (see :func:`checkable`);
    ``policies`` says what each name of ``policy`` stands for, and files of other names are not
    checkable. ``units``: ``group_id, path, unit_index, host, group_size``. A file without
    block groups is fine only if it is empty. Groups of several policies are screened in one
    scan of the cells, and only suspect stripes' payloads move; without ``screen`` there is one
    audit per policy in use, each over the cells of its own groups.
    """
    marked = materialize(checkable(files, policies).select("path", "policy", "length", "status", "msg"), "checkable")
    results, judged = [marked.where("status = 1").select("path", "status", "msg")], []
    wanted = marked.where("status is null")
    placed = units.join(wanted.select("path", "policy"), "path")
    groups = materialize(placed.select("group_id", "policy").distinct(), "groups") if len(policies) > 1 else None
    if screen and groups is not None:
        for name, stripes in audit_policies(cells, groups, policies).items():
            judged.append(group_verdict(stripes, placed.where(F.col("policy") == name), policies[name]))
    else:
        for name, policy in policies.items():
            mine, own = placed, cells
            if groups is not None:
                of_policy = groups.where(F.col("policy") == name).select("group_id")
                if not of_policy.take(1):
                    continue
                mine = placed.where(F.col("policy") == name)
                own = cells.join(F.broadcast(of_policy) if fits_broadcast(of_policy) else of_policy, "group_id", "left_semi")
            judged.append(group_verdict(audit_parity(own, policy, screen), mine, policy))
    if judged:
        results.append(whole_files(reduce(DataFrame.unionByName, judged)))
    bare = wanted.join(units.select("path"), "path", "left_anti")
    empty = F.coalesce(F.col("length") == 0, F.lit(False))
    results.append(bare.select("path", F.when(empty, 0).otherwise(1).alias("status"), F.when(~empty, NOT_READ).alias("msg")))
    return file_status(files, *results)


def audit_unit_files(files: DataFrame, units: DataFrame, captured: DataFrame, policies: Mapping[str, Policy]) -> DataFrame:
    """:func:`audit_files` on captured unit files: ``path, length, group_id, unit_index, cell_size``.

    Cells are read by ranges of the files. A group with a unit file that can't be opened is
    not checked, and neither is one that seems damaged but of which a file broke off while it
    was read; only what was read to its end is called damaged or fine.
    """
    captured = materialize(captured.select("path", "length", "group_id", "unit_index", "cell_size"), "captured")
    unread = materialize(unread_groups(captured).select("group_id"), "unread")

    def without(df: DataFrame, groups: DataFrame, how: str = "left_anti") -> DataFrame:
        return df.join(F.broadcast(groups) if fits_broadcast(groups) else groups, "group_id", how)

    cells = scan_unit_cells(without(captured, unread))
    first = materialize(audit_files(files, units, cells.where("error is null").drop("error"), policies), "audited")
    # the units of damaged files once more, to see whether they gave all their bytes
    hurt = first.where("status = -1").select("path").join(units.select("path", "group_id").distinct(), "path").select("group_id")
    again = scan_unit_cells(without(without(captured, unread), materialize(hurt, "hurt"), "left_semi"))
    broken = unread.unionByName(again.where("error is not null").select("group_id").distinct())
    skipped = without(units.select("path", "group_id"), materialize(broken, "broken"), "left_semi").select("path").distinct().withColumn("_skipped", F.lit(True))
    out = first.join(skipped, "path", "left")
    return out.select(
        "path", F.when(F.col("_skipped"), 1).otherwise(F.col("status")).cast("int").alias("status"), F.when(F.col("_skipped"), NOT_READ).otherwise(F.col("msg")).alias("msg"),
        F.when(F.col("_skipped").isNull(), F.col("bad_host")).alias("bad_host"), F.when(F.col("_skipped").isNull(), F.col("bad_block")).alias("bad_block"))
