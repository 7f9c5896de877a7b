"""Repair as table operators: which units to leave out, what they must have contained,
and which attempt succeeded."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.messages import reported_path, suspect_host
from lakecheck.operators import gf
from lakecheck.operators.gf import binaries
from lakecheck.operators.parity import Pack, Policy, audit_parity, by_stripe, only_stripes, packs, set_places
from lakecheck.session import fits_broadcast, materialize


def parse_error_report(lines: DataFrame, needle: str) -> DataFrame:
    """Paths of the report lines that contain the message ``needle``."""
    return lines.where(F.col("value").contains(needle)).select(reported_path(F.col("value")).alias("path"))


def hosts_of_groups(units: DataFrame) -> DataFrame:
    """``path, group_id, hosts``: the hosts of each block group, sorted and distinct.

    Per group and not per file, so the list is as short as the code is wide.
    """
    return units.groupBy("path", "group_id").agg(F.array_sort(F.collect_set("host")).alias("hosts"))


def host_pairs(df: DataFrame, hosts: str = "hosts") -> DataFrame:
    """One row per pair of hosts i < j of each row, with ``pair_no`` in the order
    (0,1), (0,2) .. (1,2) ..; never leaves the row, so nothing is shuffled.

    Meant for the hosts of one block group: k + m of them, so at most 91 pairs for a
    10 + 4 code. Pairs are streamed, not collected.
    """
    n = F.size(hosts)
    first = df.select("*", F.posexplode(hosts).alias("_i", "_a"))
    both = first.select("*", F.posexplode(hosts).alias("_j", "_b")).where("_i < _j")
    i, j = F.col("_i"), F.col("_j")
    number = (i * (n * 2 - i - 1) / 2).cast("int") + j - i - 1
    return both.withColumns({"pair_no": number, "pair": F.array("_a", "_b")}).drop("_i", "_j", "_a", "_b")


def plan_attempts(damaged: DataFrame, hosts: DataFrame, force: bool = True) -> DataFrame:
    """``path, group_id, attempt_no, excluded``.

    Attempt 1 leaves out the host named in the message, the others one pair of hosts each.
    ``damaged`` has ``path, msg``. Files whose message names no host get pairs only, or
    nothing if ``force`` is off.
    """
    named = damaged.select("path", suspect_host(F.col("msg")).alias("_suspect"))
    if not force:
        named = named.where("_suspect is not null")
    targets = hosts.join(named, "path")
    key = ["path", "group_id"]
    first = targets.where("_suspect is not null").select(
        *key, F.lit(1).alias("attempt_no"), F.array("_suspect").alias("excluded")
    )
    pairs = host_pairs(targets).select(
        *key, (F.col("pair_no") + 2).alias("attempt_no"), F.col("pair").alias("excluded")
    )
    return first.unionByName(pairs)


def plan_group_attempts(damaged: DataFrame, hosts: DataFrame) -> DataFrame:
    """The attempts of :func:`plan_attempts` where each damaged group has a message of its own:
    ``damaged`` has ``path, group_id, msg``, and only these groups are planned for."""
    key = ["path", "group_id"]
    targets = hosts.join(damaged.select(*key, suspect_host(F.col("msg")).alias("_suspect")), key)
    first = targets.where("_suspect is not null").select(*key, F.lit(1).alias("attempt_no"), F.array("_suspect").alias("excluded"))
    pairs = host_pairs(targets).select(*key, (F.col("pair_no") + 2).alias("attempt_no"), F.col("pair").alias("excluded"))
    return first.unionByName(pairs)


def plan_unit_attempts(damaged: DataFrame, units: DataFrame) -> DataFrame:
    """The attempts of :func:`plan_group_attempts` by the unit numbers that their hosts hold: ``path,
    group_id, attempt_no, excluded array<int>``. ``units``: ``path, group_id, unit_index, host``.

    A group's hosts and units are one row, as few as the code is wide; its attempts come out of that
    row, and no attempt is joined or aggregated.
    """
    key = ["path", "group_id"]
    held = units.where("host is not null").groupBy(*key).agg(F.collect_set(F.struct("host", F.col("unit_index").cast("int").alias("unit"))).alias("held"))
    targets = held.join(damaged.select(*key, suspect_host(F.col("msg")).alias("suspect")), key)
    targets = targets.withColumn("hosts", F.sort_array(F.array_distinct(F.transform("held", lambda u: u["host"]))))
    own = F.transform("hosts", lambda h: F.sort_array(F.transform(F.filter("held", lambda u: (u["host"] == h) & u["unit"].isNotNull()), lambda u: u["unit"])))
    targets = targets.withColumn("own", own)
    pairs = F.flatten(F.transform("own", lambda a, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda b: F.sort_array(F.array_union(a, b)))))
    nothing = F.array().cast("array<struct<attempt_no:int,excluded:array<int>>>")
    # a host without a unit of the group leaves nothing out
    named = F.coalesce(F.get("own", (F.array_position("hosts", F.col("suspect")) - 1).cast("int")), F.array().cast("array<int>"))
    first = F.when(F.col("suspect").isNull(), nothing).otherwise(F.array(F.struct(F.lit(1).alias("attempt_no"), named.alias("excluded"))))
    every = F.concat(first, F.transform(pairs, lambda pair, n: F.struct((n + 2).alias("attempt_no"), pair.alias("excluded"))))
    return targets.select(*key, F.explode(every).alias("one")).select(*key, "one.attempt_no", "one.excluded")


def best_attempts(attempts: DataFrame) -> DataFrame:
    """``path, group_id, attempt_no``: the first good attempt of every group that was tried,
    null if there is none. ``attempts`` has ``path, group_id, attempt_no, ok``."""
    good = F.when(F.coalesce("ok", F.lit(False)), F.col("attempt_no"))
    return attempts.groupBy("path", "group_id").agg(F.min(good).alias("attempt_no"))


def recovery_outcome(damaged: DataFrame, attempts: DataFrame) -> DataFrame:
    """``path, outcome, n_groups, n_recovered`` of each damaged file: ``recovered`` if every
    group that was tried has a good attempt, else ``failed``; also if none was tried."""
    per_file = best_attempts(attempts).groupBy("path").agg(F.count("*").alias("n_groups"), F.count("attempt_no").alias("n_recovered"))
    joined = damaged.select("path").distinct().join(per_file, "path", "left").fillna(0, ["n_groups", "n_recovered"])
    whole = (F.col("n_groups") > 0) & (F.col("n_groups") == F.col("n_recovered"))
    return joined.select("path", F.when(whole, "recovered").otherwise("failed").alias("outcome"), "n_groups", "n_recovered")


def unrecoverable(outcome: DataFrame) -> DataFrame:
    """Files for the next, wider pass."""
    return outcome.where("outcome = 'failed'").select("path")


# --- erasure-coded units ----------------------------------------------------------------


def reconstruct_units(cells: DataFrame, policy: Policy, excluded: DataFrame) -> DataFrame:
    """Cells of the excluded units, computed from the others.

    ``excluded`` has ``group_id, excluded array<int>`` with up to m units per group, or
    ``group_id, stripe_no, excluded`` with units of their own for each stripe that is named. A
    unit that is there but not trusted keeps its length; a missing one gets the stripe's.
    """
    check = policy.check_matrix()
    key = ["group_id", *(c for c in ["stripe_no"] if c in excluded.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, table in packs(batches, policy.n):
            asked = table["excluded"].combine_chunks().dictionary_encode()  # as many as there are unit sets
            gone_of = asked.indices.to_numpy()[pack.first]
            for number, named in enumerate(asked.dictionary.to_pylist()):
                gone, chosen = tuple(map(int, named.split(","))), gone_of == number
                if not chosen.any():
                    continue
                units = pack.units[:, np.repeat(chosen, pack.lengths)]
                units[list(gone)] = 0
                left, _ = gf.eliminate(check[:, list(gone)])
                yield _unit_rows(pack, chosen, gone, gf.matmul(left, gf.matmul(check, units)))

    usable = excluded.where(F.size(F.array_distinct("excluded")).between(1, policy.m))
    usable = usable.select(*key, F.array_join(F.array_sort(F.array_distinct("excluded")).cast("array<string>"), ",").alias("excluded"))
    side = F.broadcast(usable) if fits_broadcast(usable) else usable
    wanted = by_stripe(cells.join(side, key), policy, "excluded")
    return wanted.mapInArrow(run, "group_id bigint, stripe_no int, unit_index int, payload binary")


def rebuilt_groups(cells: DataFrame, policy: Policy, excluded: DataFrame) -> DataFrame:
    """All cells of the groups in ``excluded`` (``group_id, excluded``, a written table), those of
    the excluded units recomputed. The other cells' payloads don't move, if few groups are asked for."""
    key = ["group_id", "stripe_no", "unit_index", "payload"]
    usable = excluded.where(F.size(F.array_distinct("excluded")).between(1, policy.m)).select("group_id", "excluded")
    kept = cells.join(F.broadcast(usable) if fits_broadcast(usable) else usable, "group_id")
    kept = kept.where(~F.array_contains("excluded", F.col("unit_index"))).select(*key)
    return kept.unionByName(reconstruct_units(cells, policy, usable).select(*key))


def refused_groups(policy: Policy, excluded: DataFrame) -> DataFrame:
    """``group_id, reason`` of the groups that :func:`reconstruct_units` can't compute: more
    distinct units than the code has parities, or none. Every group asked of it has either
    cells there or a row here."""
    n = F.size(F.array_distinct("excluded"))
    reason = F.when(n > policy.m, "too many units").when(F.coalesce(n, F.lit(0)) < 1, "no units")
    return excluded.select("group_id", reason.alias("reason")).where("reason is not null")


def _unit_rows(pack: Pack, chosen: np.ndarray, gone: tuple[int, ...], solved: np.ndarray) -> pa.RecordBatch:
    """Rows for the units ``gone`` of the chosen stripes, cut from their solved bytes."""
    stripes = np.flatnonzero(chosen)
    lengths = pack.lengths[stripes]
    begins, sizes, kept = np.cumsum(lengths) - lengths, [], []
    for row, unit in enumerate(gone):
        size = np.where(pack.sizes[stripes, unit] >= 0, pack.sizes[stripes, unit], lengths)
        whole = (size == lengths).all()
        kept.append(solved[row] if whole else solved[row][np.arange(len(solved[row])) < np.repeat(begins + size, lengths)])
        sizes.append(size)
    columns = {
        "group_id": np.tile(pack.group_id[stripes], len(gone)),
        "stripe_no": np.tile(pack.stripe_no[stripes], len(gone)),
        "unit_index": np.repeat(np.array(gone, np.int32), len(stripes)),
        "payload": binaries(np.concatenate(kept), np.concatenate(sizes)),
    }
    return pa.RecordBatch.from_pydict(columns)


_PROBE = 256  # byte positions per stripe tried first; what survives is tested on all


def _explaining(pack: Pack, syndrome: np.ndarray, sets: list[tuple], nulls: list[np.ndarray]) -> np.ndarray:
    """Unit set x stripe: can errors in these units alone give the stripe's syndrome?

    ``sets`` are ordered by size; what a single unit explains, larger sets with it explain as
    well. A unit with rows that differ from each other has to be in a set.
    """
    singles = {e[0]: i for i, e in enumerate(sets) if len(e) == 1}
    hit = syndrome.any(axis=0)
    counts = np.add.reduceat(hit, pack.starts, dtype=np.int64)
    seen, ends = syndrome[:, hit], np.cumsum(counts)
    begins, tried = ends - counts, np.minimum(counts, _PROBE)
    first = seen[:, np.concatenate([np.arange(a, a + n) for a, n in zip(begins, tried)])]
    owner = np.repeat(np.arange(len(counts)), tried)

    alive = np.ones((len(sets), len(counts)), bool)
    for e, null in enumerate(nulls):
        alive[e, owner[gf.matmul(null, first).any(axis=0)]] = False
        implied = np.zeros(len(counts), bool)
        for unit in sets[e] if len(sets[e]) > 1 else ():
            if unit in singles:
                implied |= alive[singles[unit]]
        for s in np.flatnonzero(alive[e] & ~implied & (counts > _PROBE)):
            alive[e, s] = not gf.matmul(null, seen[:, begins[s] + _PROBE : ends[s]]).any()
    outside = np.array([[u not in e for u in range(pack.clashes.shape[1])] for e in sets], bool)
    return alive & ~(outside.astype(np.int64) @ pack.clashes.T.astype(np.int64)).astype(bool)


def _explained(cells: DataFrame, policy: Policy, bad: DataFrame, sets: list[tuple]) -> DataFrame:
    """``group_id, stripe_no, sets``: numbers of the unit sets that explain each stripe of
    ``bad`` (a written table). Only the payloads of these stripes move."""
    check = policy.check_matrix()
    nulls = [gf.eliminate(check[:, list(e)])[1] for e in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, _ in packs(batches, policy.n):
            syndrome = gf.matmul(check, pack.units)
            yield pack.frame({"sets": set_places(_explaining(pack, syndrome, sets, nulls).T)})

    return by_stripe(only_stripes(cells, bad), policy).mapInArrow(run, "group_id bigint, stripe_no int, sets array<int>")


def _bad_stripes(stripes: DataFrame) -> DataFrame:
    return materialize(stripes.where(F.size("bad_parity") > 0).select("group_id", "stripe_no"), "bad-stripes")


def judge_attempts(cells: DataFrame, attempts: DataFrame, policy: Policy, stripes: DataFrame | None = None) -> DataFrame:
    """``path, group_id, attempt_no, excluded, fits, proven``: what parity says of each attempt.

    ``attempts``: ``path, group_id, attempt_no, excluded array<int>`` (unit numbers). An attempt
    fits if leaving its units out makes every stripe of the group consistent. All unit sets
    that any attempt names (as many as the code is wide, not as there are groups) are
    tested in one pass over the damaged stripes; nothing is copied or rebuilt. ``proven`` says
    whether a check was left that could have contradicted it: fewer units than parities.
    """
    spark = cells.sparkSession
    asked = attempts.select("path", "group_id", "attempt_no", F.sort_array(F.array_distinct("excluded")).alias("excluded"))
    asked = materialize(asked, "asked")  # read for its sets and for the verdicts, planned once
    named = asked.select("excluded").distinct().where(F.size("excluded").between(1, policy.m) & F.forall("excluded", lambda u: u.between(0, policy.n - 1)))
    sets = sorted((tuple(r["excluded"]) for r in named.collect()), key=lambda e: (len(e), e))  # bounded by the code
    bad = _bad_stripes(audit_parity(cells, policy, screen=True) if stripes is None else stripes)
    if not sets:
        return asked.withColumns({"fits": F.lit(False), "proven": F.lit(False)})
    # a bit for each set: what explains a group is what explains all of its damaged stripes
    words = range(-(-len(sets) // 63))
    inside = [F.aggregate(F.filter("sets", lambda s: F.floor(s / 63) == w), F.lit(0).cast("bigint"), lambda bits, s: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), s % 63))) for w in words]
    votes = _explained(cells, policy, bad, sets).groupBy("group_id").agg(F.count("*").alias("n"), *(F.bit_and(bits).alias(f"w{w}") for w, bits in zip(words, inside)))
    votes = bad.groupBy("group_id").agg(F.count("*").alias("n_bad")).join(votes, "group_id", "left")
    numbered = F.array(*(F.struct(F.array(*map(F.lit, e)).alias("excluded"), F.lit(i).alias("s")) for i, e in enumerate(sets)))
    numbers = spark.range(1).select(F.inline(numbered))
    judged = asked.join(F.broadcast(numbers), "excluded", "left").join(votes, "group_id", "left")
    bit = reduce(lambda found, w: found.when(F.floor(F.col("s") / 63) == w, F.col(f"w{w}")), words, F.when(F.lit(False), F.lit(0).cast("bigint")))
    # a group without a damaged stripe is explained by any set
    every = F.coalesce(F.col("n") == F.col("n_bad"), F.lit(False)) & (F.call_function("shiftright", bit, F.col("s") % 63).bitwiseAND(F.lit(1)) == 1)
    fits = F.col("s").isNotNull() & (F.col("n_bad").isNull() | every)
    return judged.select("path", "group_id", "attempt_no", "excluded", fits.alias("fits"), (F.size("excluded") < policy.m).alias("proven"))


def locate_bad_units(cells: DataFrame, policy: Policy, stripes: DataFrame | None = None) -> DataFrame:
    """Which units of a damaged group are wrong: ``group_id, n_stripes, outcome, unit_sets``.

    A set of units explains a group if leaving it out makes every stripe consistent; single
    units are preferred to pairs. ``located``: exactly one smallest set, and at least one
    check is left that could have contradicted it. ``candidate``: several such sets, or as
    many units as parities, where parity proves nothing and the content has to be checked.
    ``located_per_stripe``: no set for the whole group is proven, but one for each damaged stripe is;
    :func:`locate_per_stripe` names them. ``failed``: no set of as many units as the code can place (m - 1, and m where that is 1
    or 2). Only stripes that fail the audit (``stripes``, else computed) are looked at.
    """
    sets = unit_sets(policy)
    explained = _explained(cells, policy, _bad_stripes(audit_parity(cells, policy, screen=True) if stripes is None else stripes), sets)
    per_stripe = materialize(explained, "explained")

    # set -1 stands for the stripe itself; the sets per group are as many as the code allows
    votes = per_stripe.select("group_id", F.explode(F.array_append("sets", F.lit(-1))).alias("s"))
    counts = votes.groupBy("group_id", "s").agg(F.count("*").alias("n"))
    meaning = _meaning(sets)
    groups = counts.groupBy("group_id").agg(
        F.max(F.when(F.col("s") == -1, F.col("n"))).alias("n_stripes"),
        F.collect_list(F.when(F.col("s") >= 0, F.struct("s", "n"))).alias("seen"),
    )
    always = F.filter("seen", lambda x: x["n"] == F.col("n_stripes"))
    named = F.array_sort(F.transform(always, lambda x: F.get(meaning, x["s"])))
    smallest = F.array_min(F.transform("named", F.size))
    best = groups.withColumn("named", named).withColumn(
        "unit_sets", F.filter("named", lambda e: F.size(e) == smallest)
    )
    proven = (F.size("unit_sets") == 1) & (F.size(F.get("unit_sets", F.lit(0))) < policy.m)
    alone = _located_stripes(per_stripe, sets, policy).groupBy("group_id").agg(F.count("*").alias("n_alone"))
    every = best.join(alone, "group_id", "left")
    each = F.coalesce("n_alone", F.lit(0)) == F.col("n_stripes")
    outcome = F.when(proven, "located").when(each, "located_per_stripe").when(F.size("unit_sets") == 0, "failed").otherwise("candidate")
    return every.select("group_id", "n_stripes", outcome.alias("outcome"), F.when(outcome == "located_per_stripe", F.array().cast("array<array<int>>")).otherwise(F.col("unit_sets")).alias("unit_sets"))


def unit_sets(policy: Policy) -> list[tuple]:
    """Sets of units that may be wrong together, by size: of as many units as the code can place."""
    most = policy.m if policy.m <= 2 else policy.m - 1
    return [e for size in range(1, most + 1) for e in combinations(range(policy.n), size)]


def _meaning(sets: list[tuple]) -> Column:
    return F.array(*(F.array(*map(F.lit, e)) for e in sets))


def _located_stripes(explained: DataFrame, sets: list[tuple], policy: Policy) -> DataFrame:
    """``group_id, stripe_no, excluded`` of the stripes with exactly one smallest set, one that
    a check could have contradicted."""
    named = explained.withColumn("named", F.transform("sets", lambda i: F.get(_meaning(sets), i)))
    least = F.array_min(F.transform("named", F.size))
    best = named.withColumn("best", F.filter("named", lambda e: F.size(e) == least))
    alone = best.where(F.size("best") == 1).select("group_id", "stripe_no", F.get("best", F.lit(0)).alias("excluded"))
    return alone.where(F.size("excluded") < policy.m)


def locate_per_stripe(cells: DataFrame, policy: Policy, stripes: DataFrame) -> DataFrame:
    """``group_id, stripe_no, excluded``: the wrong units of each damaged stripe, where parity
    proves which they are; other units in each stripe of a group are no hindrance. ``stripes``
    is an audit's result, or the part of it that is asked for."""
    sets = unit_sets(policy)
    return _located_stripes(_explained(cells, policy, _bad_stripes(stripes), sets), sets, policy)
