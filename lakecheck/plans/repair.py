"""Damaged files -> suspect units -> what they must have held -> attempts and outcome."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.operators.filecheck import check_content
from lakecheck.operators.parity import Policy, audit_parity, only_groups
from lakecheck.operators.recovery import best_attempts, judge_attempts, locate_bad_units, locate_per_stripe, rebuilt_groups, reconstruct_units
from lakecheck.session import fits_broadcast, materialize
from lakecheck.sources.files import with_table
from lakecheck.sources.tables import PARTS
from lakecheck.sources.units import write_parts


class Repair(NamedTuple):
    """``located``: verdict per damaged group; ``damaged``: all cells of these groups;
    ``fixed``: the recomputed cells of the groups, or stripes, whose bad units are known."""

    located: DataFrame
    damaged: DataFrame
    fixed: DataFrame


def repair_units(cells: DataFrame, policy: Policy, screen: bool = True) -> Repair:
    """Audit all cells, then find and recompute the bad units of the damaged groups.

    ``cells`` is read for the audit, and once more to copy the damaged groups to the shared
    folder; every later step works on that copy. Stripes of a group may have different bad units. Groups that are only ``candidate`` need
    the content check of each of their unit sets; :func:`candidate_sets` lists them.
    """
    bad = materialize(audit_parity(cells, policy, screen, bad_only=True), "bad-stripes")
    groups = materialize(bad.select("group_id").distinct(), "bad-groups")
    damaged = materialize(only_groups(cells, groups), "damaged-cells")
    located = materialize(locate_bad_units(damaged, policy, stripes=bad), "located")
    known = located.where("outcome = 'located'").select("group_id", F.get("unit_sets", F.lit(0)).alias("excluded"))
    fixed = reconstruct_units(damaged, policy, known)
    apart = located.where("outcome = 'located_per_stripe'").select("group_id")
    if apart.take(1):
        sets = materialize(locate_per_stripe(damaged, policy, bad.join(apart, "group_id", "left_semi")), "stripe-sets")
        fixed = fixed.unionByName(reconstruct_units(damaged, policy, sets))
    return Repair(located, damaged, fixed)


def candidate_sets(located: DataFrame) -> DataFrame:
    """``group_id, attempt_no, excluded``: unit sets that only a content check can decide."""
    open_groups = located.where("outcome = 'candidate'")
    sets = open_groups.select("group_id", F.posexplode("unit_sets").alias("n", "excluded"))
    return sets.select("group_id", (F.col("n") + 1).alias("attempt_no"), "excluded")


def repaired_cells(cells: DataFrame, fixed: DataFrame) -> DataFrame:
    """All cells, with the recomputed ones in place of those they replace."""
    key = ["group_id", "stripe_no", "unit_index"]
    kept = cells.select(*key, "payload").join(fixed.select(*key), key, "left_anti")
    return kept.unionByName(fixed.select(*key, "payload"))


def verify_repair(cells: DataFrame, fixed: DataFrame, policy: Policy) -> DataFrame:
    """``group_id, ok``: parity of the repaired groups, checked again; ``cells`` may be the
    copy of the damaged groups."""
    groups = fixed.select("group_id").distinct()
    again = audit_parity(repaired_cells(cells.join(groups, "group_id", "left_semi"), fixed), policy)
    return again.groupBy("group_id").agg(F.bool_and(F.size("bad_parity") == 0).alias("ok"))


def attempt_units(attempts: DataFrame, units: DataFrame) -> DataFrame:
    """``path, group_id, attempt_no, excluded``: the unit numbers that an attempt's hosts hold.

    ``attempts``: ``path, group_id, attempt_no, excluded`` with hosts; ``units``: ``path,
    group_id, unit_index, host``. Hosts without a unit of the group leave nothing out.
    """
    hosts = attempts.select("path", "group_id", "attempt_no", F.explode("excluded").alias("host"))
    held = hosts.join(units.select("path", "group_id", "host", "unit_index"), ["path", "group_id", "host"], "left")
    return held.groupBy("path", "group_id", "attempt_no").agg(F.array_sort(F.collect_set("unit_index")).alias("excluded"))


def try_attempts(cells: DataFrame, attempts: DataFrame, policy: Policy, stripes: DataFrame | None = None) -> DataFrame:
    """``path, group_id, attempt_no, excluded, fits, proven, ok`` of attempts as given by
    :func:`attempt_units`.

    An attempt is good if leaving its units out makes the parity of every stripe right and a
    check was left that could have said otherwise; with as many units left out as there are
    parities that proves nothing, and content decides: :func:`repair_files`. All attempts are
    judged in one pass over the damaged stripes (``stripes``: an audit's result, else
    computed); no cell is copied for an attempt.
    """
    judged = judge_attempts(cells, attempts, policy, stripes)
    return materialize(judged.withColumn("ok", F.col("fits") & F.col("proven")), "outcome")


def winners(outcome: DataFrame) -> DataFrame:
    """``path, group_id, attempt_no, excluded`` of the first good attempt of each group."""
    return _sets_of(best_attempts(outcome), outcome)


def _sets_of(best: DataFrame, outcome: DataFrame) -> DataFrame:
    good = outcome.where("ok").select("path", "group_id", "attempt_no", "excluded")
    return best.where("attempt_no IS NOT NULL").join(good, ["path", "group_id", "attempt_no"])


def recovered_cells(cells: DataFrame, outcome: DataFrame, policy: Policy) -> DataFrame:
    """``path, group_id, stripe_no, unit_index, payload`` of the first good attempt of each
    group, for the files of which every group that was tried has one."""
    best = materialize(best_attempts(outcome), "best-attempts")
    whole = best.groupBy("path").agg(F.bool_and(F.col("attempt_no").isNotNull()).alias("whole")).where("whole").select("path")
    kept = materialize(_sets_of(best.join(whole, "path", "left_semi"), outcome).select("path", "group_id", "excluded"), "best")
    places = kept.select("group_id", "path")
    fixed = rebuilt_groups(cells, policy, kept.select("group_id", "excluded"))
    return fixed.join(F.broadcast(places) if fits_broadcast(places) else places, "group_id").select("path", "group_id", "stripe_no", "unit_index", "payload")


# --- whole files, decided by their content ------------------------------------------------


def file_pieces(cells: DataFrame, layout: DataFrame, policy: Policy) -> DataFrame:
    """``target, at, payload``: the bytes of files, from the data cells of their groups.

    ``layout``: ``group_id, target, group_start, group_size``: where in which file a group's
    bytes go. Cells are cut where their group ends; missing ones are for the writer to fill.
    """
    data = cells.where(F.col("unit_index").between(0, policy.k - 1))
    placed = data.join(F.broadcast(layout) if fits_broadcast(layout) else layout, "group_id")
    inside = (F.col("stripe_no").cast("long") * policy.k + F.col("unit_index")) * policy.cell_size
    n = F.least(F.octet_length("payload").cast("long"), F.col("group_size") - inside)
    cut = F.when(n < F.octet_length("payload"), F.substring(F.col("payload"), F.lit(1), n.cast("int"))).otherwise(F.col("payload"))
    return placed.where(n > 0).select("target", (F.col("group_start") + inside).alias("at"), cut.alias("payload"))


class FileRepair(NamedTuple):
    """``outcome``: ``path, outcome, attempt_no, target, msg``; ``tried``: ``path, attempt_no, status, msg``
    of every content check that was made."""

    outcome: DataFrame
    tried: DataFrame


def repair_files(
    cells: DataFrame, files: DataFrame, groups: DataFrame, attempts: DataFrame, policy: Policy, registry: DataFrame, folder: str, stripes: DataFrame | None = None
) -> FileRepair:
    """Rebuild damaged files and let their content decide between attempts.

    ``files``: ``path, length`` of the damaged files, whose last two folders name database and
    table; ``groups``: ``path, group_id, group_no, group_size`` of all their groups;
    ``attempts``: ``path, attempt_no, group_id, excluded array<int>``: an attempt leaves the same
    hosts out in all damaged groups of a file, so ``excluded`` are the units that they hold, and
    a group without a row in an attempt takes part as it is.

    Attempts that parity refutes in any damaged group are out. The others are made one by
    one for each file, all files side by side: damaged groups are rebuilt, the file's cells are
    written below ``folder`` by many tasks, a part each, and checked by the table's format
    like any file. A file that fails goes on to its next attempt, so rounds are as many as the
    attempts of a file that parity can't refute (3 for one xor group, 10 for two units of
    RS(3,2)). Only the cells of files still open are read again.
    """
    stripes = materialize(audit_parity(cells, policy, screen=True) if stripes is None else stripes, "stripes")
    hurt = stripes.where(F.size("bad_parity") > 0).select("group_id").distinct()
    damaged = materialize(groups.join(hurt, "group_id").select("path", "group_id"), "damaged-groups")
    judged = judge_attempts(cells, attempts.join(hurt, "group_id", "left_semi"), policy, stripes)
    # every damaged group of the file has to fit
    needed = damaged.groupBy("path").agg(F.count("*").alias("n"))
    fitting = judged.where("fits").groupBy("path", "attempt_no").agg(F.count("*").alias("n"))
    ranked = fitting.join(needed, ["path", "n"], "left_semi").select("path", "attempt_no")
    order = Window.partitionBy("path").orderBy("attempt_no")  # as many rows as a file has attempts
    waiting = materialize(ranked.select("path", "attempt_no", F.row_number().over(order).alias("turn")), "attempts-left")
    chosen = materialize(judged.where("fits").select("path", "attempt_no", "group_id", "excluded"), "fitting")
    starts = groups.withColumn("group_start", F.coalesce(F.sum("group_size").over(Window.partitionBy("path").orderBy("group_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = materialize(starts.select("path", "group_id", "group_start", "group_size"), "group-starts")
    tried, turn = [], 1
    while True:
        now = waiting.where(F.col("turn") == turn).select("path", "attempt_no")
        if tried:
            done = tried[-1].where("status = 0").select("path")
            waiting = materialize(waiting.join(F.broadcast(done) if fits_broadcast(done) else done, "path", "left_anti"), "attempts-left")
            now = waiting.where(F.col("turn") == turn).select("path", "attempt_no")
        if not now.take(1):
            break
        own = files.select("path", "length").join(now, "path").withColumn("target", rebuilt_path(folder, F.col("path"), F.col("attempt_no")))
        own = materialize(own, "targets")
        layout = materialize(starts.join(own.select("path", "target", "attempt_no"), "path"), "layout")
        leave = materialize(chosen.join(now, ["path", "attempt_no"], "left_semi").select("group_id", "excluded"), "left-out")
        intact = layout.select("group_id").join(leave.select("group_id"), "group_id", "left_anti")
        fixed = cells.join(F.broadcast(intact) if fits_broadcast(intact) else intact, "group_id", "left_semi").select("group_id", "stripe_no", "unit_index", "payload")
        fixed = fixed.unionByName(rebuilt_groups(cells, policy, leave))
        pieces = file_pieces(fixed, layout.select("group_id", "target", "group_start", "group_size"), policy)
        written = materialize(write_parts(pieces, own.select("target", "length")), "written")
        listed = with_table(own.join(written.groupBy("target").agg(F.sum("length").alias("_written")), "target").select(F.col("target").alias("path"), "length"))
        checked = check_content(listed, registry).select(F.col("path").alias("target"), "status", "msg")
        tried.append(materialize(own.join(checked, "target", "left").select("path", "attempt_no", "target", F.coalesce("status", F.lit(1)).alias("status"), "msg"), "tried"))
        turn += 1
    every = reduce(DataFrame.unionByName, tried) if tried else cells.sparkSession.createDataFrame([], "path string, attempt_no int, target string, status int, msg string")
    best = every.where("status = 0").select("path", "attempt_no", "target")
    said = every.groupBy("path").agg(F.max_by("msg", "attempt_no").alias("msg"))
    outcome = files.select("path").join(best, "path", "left").join(said, "path", "left")
    named = F.when(F.col("target").isNotNull(), "recovered").otherwise("failed")
    return FileRepair(outcome.select("path", named.alias("outcome"), "attempt_no", "target", F.when(F.col("target").isNull(), F.col("msg")).alias("msg")), every.drop("target"))


def rebuilt_path(folder: str, path: Column, attempt: Column) -> Column:
    """Where an attempt's file goes: the same database and table, so that its format is known."""
    inside = F.regexp_extract(path, r"([^/]+\.db/.*)$", 1)
    return F.concat(F.lit(f"{folder.rstrip('/')}/attempt="), attempt.cast("string"), F.lit("/"), inside, F.lit(PARTS))
