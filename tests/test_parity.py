from __future__ import annotations

import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecheck.operators import gf, parity, recovery, verdict
from lakecheck.operators.parity import Policy
from lakecheck.plans.audit import audit_files
from lakecheck.plans.repair import attempt_units, candidate_sets, recovered_cells, repair_units, try_attempts, verify_repair

CELLS = "group_id bigint, stripe_no int, unit_index int, payload binary"
POLICIES = [Policy(2, 1, "xor"), Policy(3, 2), Policy(6, 3), Policy(10, 4)]


def slow_product(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1) ^ (gf.POLYNOMIAL if a & 0x80 else 0)
        b >>= 1
    return out


def coded(policy: Policy, groups: int, seed: int = 1, size: int = 40) -> dict[tuple, bytes]:
    """Intact cells of 3 stripes per group, computed with plain loops; the last data unit of
    the last stripe is short and the one before it is missing if there are enough."""
    rng, matrix, cells = random.Random(seed), policy.parity_matrix(), {}
    for g in range(groups):
        for s in range(3):
            data = [rng.randbytes(size) for _ in range(policy.k)]
            if s == 2:
                data[-1] = data[-1][:7]
                if policy.k > 2:
                    data[-2] = b""
            filled = [d.ljust(size, b"\0") for d in data]
            rows = [
                bytes(np.bitwise_xor.reduce([slow_product(int(c), d[i]) for c, d in zip(row, filled)]) for i in range(size))
                for row in matrix
            ]
            for u, payload in enumerate(data + rows):
                if payload:
                    cells[-g, s, u] = payload
    return cells


def frame(spark, cells: dict[tuple, bytes]):
    rows = [(*key, bytearray(v)) for key, v in cells.items()]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, CELLS)


def flip(cells: dict, g: int, s: int, u: int, *positions: int) -> None:
    data = bytearray(cells[-g, s, u])
    for p in positions:
        data[p] ^= 1 + p % 255
    cells[-g, s, u] = bytes(data)


def flip_many(cells: dict, g: int, s: int, u: int, seed: int) -> None:
    rng = random.Random(seed)
    cells[-g, s, u] = bytes(b ^ rng.randrange(1, 256) for b in cells[-g, s, u])


def as_dict(df) -> dict[tuple, bytes]:
    return {(r["group_id"], r["stripe_no"], r["unit_index"]): bytes(r["payload"]) for r in df.collect()}


def bad_stripes(df) -> dict[tuple, list[int]]:
    return {(r["group_id"], r["stripe_no"]): r["bad_parity"] for r in df.collect() if r["bad_parity"]}


def test_field_tables():
    product, inverse = gf.tables()
    rng = random.Random(2)
    for a, b in [(rng.randrange(256), rng.randrange(256)) for _ in range(500)] + [(0, 9), (9, 0), (1, 7)]:
        assert product[a, b] == slow_product(a, b)
    assert all(product[a, inverse[a]] == 1 for a in range(1, 256)) and inverse[0] == 0


@pytest.mark.parametrize("policy", POLICIES, ids=str)
def test_any_k_units_decode(policy):
    check = policy.check_matrix()
    for gone in itertools.combinations(range(policy.n), policy.m):
        left, null = gf.eliminate(check[:, list(gone)])
        assert (gf.matmul(left, check[:, list(gone)]) == np.eye(policy.m)).all() and not len(null)


def test_policy_is_checked():
    for wrong in [(2, 2, "xor"), (0, 1, "rs"), (250, 10, "rs"), (3, 1, "zip")]:
        with pytest.raises(ValueError):
            Policy(*wrong)


@pytest.mark.parametrize("policy", POLICIES, ids=str)
def test_encode_and_audit(spark, conf, policy):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # stripes cross batch borders
    cells = coded(policy, 4)
    data = {key: v for key, v in cells.items() if key[2] < policy.k}
    assert as_dict(parity.encode(frame(spark, data), policy)) == {k: v for k, v in cells.items() if k[2] >= policy.k}
    assert bad_stripes(parity.audit_parity(frame(spark, cells), policy)) == {}
    flip(cells, 1, 0, 0, 3)  # a data unit: every parity differs
    flip(cells, 2, 1, policy.n - 1, 5)  # the last parity unit: only that one
    flip(cells, 3, 2, policy.k - 1, 0, 6)  # the short unit
    expected = {(-1, 0): list(range(policy.m)), (-2, 1): [policy.m - 1], (-3, 2): list(range(policy.m))}
    df = frame(spark, cells)
    exact = parity.audit_parity(df.unionByName(df.limit(5)), policy)  # repeated rows change nothing
    assert bad_stripes(exact) == expected and exact.count() == 12
    screened = parity.audit_parity(df, policy, screen=True)
    assert bad_stripes(screened) == expected and screened.count() == 12
    suspects = parity.screen_parity(df, policy).where("suspect")
    assert {(r["group_id"], r["stripe_no"]) for r in suspects.collect()} == set(expected)


@pytest.mark.parametrize("screen", [False, True])
def test_repeated_rows_hide_nothing(spark, screen):
    policy = Policy(3, 2)
    cells = coded(policy, 2)
    cells[0, 1, 0] = bytes(len(cells[0, 1, 0]))  # wrong, and delivered twice: its checksums cancel out
    wrong = frame(spark, {(0, 1, 0): cells[0, 1, 0]})
    other = frame(spark, {(-1, 0, 2): b"other", (-1, 2, 4): b"parity"})  # second rows that differ from the first
    got = bad_stripes(parity.audit_parity(frame(spark, cells).unionByName(wrong).unionByName(other), policy, screen=screen))
    assert got == {(0, 1): [0, 1], (-1, 0): [0, 1], (-1, 2): [1]}


def test_stripes_stay_whole_after_joins(spark, tmp_path):
    """Many input files of incompressible cells, so that every exchange is read by many tasks."""
    policy, rng, rows = Policy(6, 3), np.random.default_rng(5), []
    for g in range(60):
        data = rng.integers(0, 256, (6, 1 << 15), dtype=np.uint8)
        whole = np.concatenate([data, gf.matmul(policy.parity_matrix(), data)])
        whole[0, 7] ^= 0xFF if g % 12 == 0 else 0
        rows += [(g, 0, u, whole[u].tobytes()) for u in range(9)]
    df = spark.createDataFrame(rows, "group_id bigint, stripe_no int, unit_index int, payload binary").repartition(12)
    df.write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    exact, screened = (parity.audit_parity(cells, policy, screen=s) for s in (False, True))
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, screened.collect())) and screened.count() == 60
    got = recovery.locate_bad_units(cells, policy).collect()
    assert {(r["group_id"], r["n_stripes"], r["outcome"], str(r["unit_sets"])) for r in got} == {(g, 1, "located", "[[0]]") for g in range(0, 60, 12)}


def test_refused_groups_have_a_reason(spark):
    asked = spark.createDataFrame([(1, [0, 1, 1]), (2, [0, 1, 2]), (3, []), (4, None)], "group_id bigint, excluded array<int>")
    got = {r["group_id"]: r["reason"] for r in recovery.refused_groups(Policy(3, 2), asked).collect()}
    assert got == {2: "too many units", 3: "no units", 4: "no units"}


def test_attempts_are_tried(spark):
    policy = Policy(3, 2)
    good = coded(policy, 3, seed=8)
    cells = dict(good)
    flip_many(cells, 1, 0, 1, 1)
    flip_many(cells, 2, 0, 0, 2)
    flip_many(cells, 2, 0, 3, 3)
    held = units(spark, {-1: "/f", -2: "/f"}, policy)
    rows = [("/f", -1, 1, ["10.0.0.4"]), ("/f", -1, 2, ["10.0.0.1"]), ("/f", -2, 1, ["10.0.0.0"]), ("/f", -2, 2, ["10.0.0.0", "10.0.0.3"])]
    attempts = attempt_units(spark.createDataFrame(rows, "path string, group_id bigint, attempt_no int, excluded array<string>"), held)

    outcome = try_attempts(frame(spark, cells), attempts, policy)
    got = {(r["group_id"], r["attempt_no"]): (r["fits"], r["proven"], r["ok"]) for r in outcome.collect()}
    assert got == {(-1, 1): (False, True, False), (-1, 2): (True, True, True), (-2, 1): (False, True, False), (-2, 2): (True, False, False)}  # two units of two parities prove nothing
    assert recovered_cells(frame(spark, cells), outcome, policy).count() == 0  # one group of the file has no good attempt
    alone = outcome.withColumn("path", F.concat("path", F.col("group_id").cast("string")))
    rebuilt = {(r["group_id"], r["stripe_no"], r["unit_index"]): bytes(r["payload"]) for r in recovered_cells(frame(spark, cells), alone, policy).collect()}
    assert {k for k in good if k[0] == -1} <= set(rebuilt) and {k[0] for k in rebuilt} == {-1}
    assert all(rebuilt[k].rstrip(b"\0") == v.rstrip(b"\0") for k, v in good.items() if k[0] == -1)


def test_attempts_copy_nothing(spark):
    """Many attempts of many groups write less than the damaged cells."""
    policy = Policy(10, 4)
    cells = coded(policy, 6, seed=4, size=20_000)
    for g in range(1, 6):
        flip_many(cells, g, 0, g, 7)
    df = frame(spark, cells)
    stripes = parity.audit_parity(df, policy)
    rows = [("/f", -g, n, list(e)) for g in range(1, 6) for n, e in enumerate(itertools.combinations(range(14), 2), 1)]
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.rglob("*.parquet"))
    outcome = try_attempts(df, spark.createDataFrame(rows, "path string, group_id bigint, attempt_no int, excluded array<int>"), policy, stripes)
    fits = {(r["group_id"], tuple(r["excluded"])) for r in outcome.where("fits").collect()}
    assert fits == {(-g, e) for g in range(1, 6) for e in itertools.combinations(range(14), 2) if g in e}
    written = sum(f.stat().st_size for f in set(shared.rglob("*.parquet")) - before)
    assert written < 100_000 < sum(len(v) for v in cells.values())


def test_a_unit_that_clashes_has_to_go(spark):
    policy = Policy(6, 3)
    cells = coded(policy, 2)
    extra = spark.createDataFrame([(-1, 0, 2, bytearray(b"z" * 40))], CELLS)
    attempts = spark.createDataFrame([("/f", -1, 1, [2]), ("/f", -1, 2, [3])], "path string, group_id bigint, attempt_no int, excluded array<int>")
    got = {r["attempt_no"]: r["fits"] for r in try_attempts(frame(spark, cells).unionByName(extra), attempts, policy).collect()}
    assert got == {1: True, 2: False}


def test_other_units_in_each_stripe(spark):
    policy = Policy(6, 3)
    good = coded(policy, 3, seed=6)
    cells = dict(good)
    for s, u in enumerate((0, 3, 7)):
        flip_many(cells, 1, s, u, s)
    for u in (1, 5):
        flip_many(cells, 2, 0, u, u)
    repair = repair_units(frame(spark, cells), policy)
    assert located(repair.located) == {1: ("located_per_stripe", []), 2: ("located", [[1, 5]])}
    fixed = as_dict(repair.fixed)
    assert {k for k in fixed if k[0] == -1} == {(-1, 0, 0), (-1, 1, 3), (-1, 2, 7)}
    assert all(fixed[k].rstrip(b"\0") == good.get(k, b"").rstrip(b"\0") for k in fixed)
    assert all(r["ok"] for r in verify_repair(repair.damaged, repair.fixed, policy).collect())


def test_a_stray_stripe_is_no_evidence(spark):
    """A group without a known size, or with a stripe past its end in place of one of its own."""
    policy = Policy(3, 2)
    cells = {(-g, 57 if g == 1 and s == 1 else s, u): v for (g, s, u), v in ((( -k[0], k[1], k[2]), v) for k, v in coded(policy, 4).items())}
    held = units(spark, {0: "/ok", -1: "/stray", -2: "/unsized", -3: "/two", -9: "/two"}, policy, size=3 * policy.k << 20)
    held = held.withColumn("group_size", F.when(F.col("group_id") != -2, F.col("group_size")))
    stripes = parity.audit_parity(frame(spark, cells), policy)
    got = {r["group_id"]: r["status"] for r in parity.group_verdict(stripes, held, policy).collect()}
    assert got == {0: 0, -1: 1, -2: 1, -3: 0, -9: 1}
    files = spark.createDataFrame([(p, True, True, True, "rs", 1) for p in ("/ok", "/stray", "/unsized", "/two")], "path string, exists boolean, is_file boolean, is_closed boolean, policy string, length int")
    for policies in ({"rs": policy}, {"rs": policy, "other": Policy(6, 3)}):
        audited = {r["path"]: r["status"] for r in audit_files(files, held, frame(spark, cells), policies).collect()}
        assert audited == {"/ok": 0, "/stray": 1, "/unsized": 1, "/two": 1}  # a group that nobody read keeps the file from being fine


def test_screen_of_several_codes(spark):
    """One scan answers for every code what a screen of that code alone does."""
    for own in POLICIES:
        cells = coded(own, 5)
        flip(cells, 3, 1, own.n - 1, 2)
        df = frame(spark, cells)
        got = {(r["group_id"], r["stripe_no"]): r["suspects"][POLICIES.index(own)] for r in parity.screen_policies(df, POLICIES).collect()}
        assert {k for k, suspect in got.items() if suspect} == {(-3, 1)} and len(got) == 15


def test_audit_xor_words(spark):
    rows = [(g, 0, w, u, (g * 31 + w * 7 + u) ** 5 % (1 << 62)) for g in range(5) for w in range(4) for u in range(3)]
    words = spark.createDataFrame(rows, "group_id bigint, stripe_no int, word_no int, unit_index int, word bigint")
    closing = words.groupBy("group_id", "stripe_no", "word_no").agg(F.bit_xor("word").alias("word")).withColumn("unit_index", F.lit(3))
    whole = words.unionByName(closing)
    assert bad_stripes(parity.audit_xor(whole)) == {}
    hurt = whole.withColumn("word", F.when(F.expr("group_id = 2 and word_no = 1 and unit_index = 0"), -1).otherwise(F.col("word")))
    assert bad_stripes(parity.audit_xor(hurt)) == {(2, 0): [0]}


@pytest.mark.parametrize("policy", POLICIES, ids=str)
def test_reconstruct_up_to_m_units(spark, policy):
    cells, rng = coded(policy, 6, seed=9), random.Random(4)
    gone = {-g: sorted(rng.sample(range(policy.n), rng.randint(1, policy.m))) for g in range(6)}
    kept = {k: v for k, v in cells.items() if k[2] not in gone[k[0]] or k[0] % 2}
    for key in [k for k in kept if k[2] in gone[k[0]]]:
        kept[key] = bytes(len(kept[key]))  # there, but all wrong: its length is kept
    excluded = spark.createDataFrame(list(gone.items()), "group_id bigint, excluded array<int>")
    fixed = as_dict(recovery.reconstruct_units(frame(spark, kept), policy, excluded))
    for (g, s, u), payload in fixed.items():
        assert u in gone[g] and payload.rstrip(b"\0") == cells.get((g, s, u), b"").rstrip(b"\0")
        if (g, s, u) in kept:
            assert payload == cells[g, s, u]
    assert {k for k in cells if k[2] in gone[k[0]]} <= set(fixed)


def located(df) -> dict[int, tuple]:
    return {-r["group_id"]: (r["outcome"], r["unit_sets"]) for r in df.collect()}


def test_locate(spark, conf):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    policy = Policy(6, 3)
    cells = coded(policy, 7, size=700)
    flip(cells, 1, 0, 2, 11)
    flip(cells, 2, 1, 7, 600)
    for s in range(2):
        flip_many(cells, 3, s, 0, 10 + s)
        flip_many(cells, 3, s, 4, 20 + s)
    flip(cells, 4, 0, 1, 9)  # different units in two stripes: only the pair explains both
    flip(cells, 4, 1, 8, 9)
    for u in (0, 3, 6):
        flip_many(cells, 5, 0, u, u)
    del cells[-6, 0, 5]  # a lost unit counts as zeros and is found as such
    got = located(recovery.locate_bad_units(frame(spark, cells), policy))
    assert got == {
        1: ("located", [[2]]), 2: ("located", [[7]]), 3: ("located", [[0, 4]]), 4: ("located", [[1, 8]]),
        5: ("failed", []), 6: ("located", [[5]]),
    }


def test_locate_without_evidence(spark):
    weak, xor = Policy(3, 2), Policy(2, 1, "xor")
    cells = coded(weak, 2, size=300)
    flip_many(cells, 0, 0, 0, 1)
    flip_many(cells, 0, 0, 1, 2)
    flip(cells, 1, 0, 2, 3)
    got = located(recovery.locate_bad_units(frame(spark, cells), weak))
    assert got[1] == ("located", [[2]])
    assert got[0] == ("candidate", [list(e) for e in itertools.combinations(range(5), 2)])
    cells = coded(xor, 1)
    flip(cells, 0, 0, 0, 3)
    found = recovery.locate_bad_units(frame(spark, cells), xor)
    assert located(found) == {0: ("candidate", [[0], [1], [2]])}
    assert [r["excluded"] for r in candidate_sets(found).orderBy("attempt_no").collect()] == [[0], [1], [2]]


def test_repair_gives_the_original(spark):
    policy = Policy(6, 3)
    good = coded(policy, 5, seed=3)
    cells = dict(good)
    flip_many(cells, 1, 0, 1, 1)
    flip_many(cells, 2, 2, 5, 2)
    flip_many(cells, 2, 2, 8, 3)
    df = frame(spark, cells)
    repair = repair_units(df, policy)
    assert {r["outcome"] for r in repair.located.collect()} == {"located"}
    rebuilt = as_dict(repair.fixed)
    assert all(rebuilt[k] == good[k] for k in rebuilt if k in good) and len(rebuilt) >= 9
    assert {(r["group_id"], r["ok"]) for r in verify_repair(repair.damaged, repair.fixed, policy).collect()} == {(-1, True), (-2, True)}


# --- verdicts ---------------------------------------------------------------------------

UNITS = "group_id bigint, path string, unit_index int, host string, group_size bigint"


def units(spark, groups: dict[int, str], policy: Policy, size: int = 1 << 30, lost: int = 0):
    rows = [(g, p, u, f"10.0.0.{u}", size) for g, p in groups.items() for u in range(policy.n - lost)]
    return spark.createDataFrame(rows, UNITS)


@pytest.mark.parametrize("size, n, short", [(1, 4, False), (1, 3, True), (1 << 20, 4, False), ((1 << 20) + 1, 4, True), (1 << 30, 9, False), (1 << 30, 8, True)])
def test_under_coded(spark, size, n, short):
    policy = Policy(6, 3)
    found = parity.under_coded(units(spark, {1: "p"}, policy, size, lost=policy.n - n), policy).first()
    assert found["under_coded"] is short


def test_worst_group_wins(spark):
    """First group damaged, last group fine: the file is damaged and names host and block."""
    policy = Policy(3, 2)
    cells = coded(policy, 2)
    flip(cells, 1, 0, 4, 2)
    groups = units(spark, {0: "/w/f", -1: "/w/f", -2: "/w/short", -9: "/w/unread"}, policy, size=3 * policy.k << 20).where("not (group_id = -2 and unit_index = 0)")
    meta = [("/w/f", True, True, True, "rs"), ("/w/short", True, True, True, "rs"), ("/w/none", False, None, None, None),
            ("/w/dir", True, False, True, "rs"), ("/w/open", True, True, False, "rs"), ("/w/plain", True, True, True, None), ("/w/empty", True, True, True, "rs"), ("/w/bare", True, True, True, "rs"),
            ("/w/unread", True, True, True, "rs"), ("/w/odd", True, True, True, "rs-9-9")]
    files = spark.createDataFrame(meta, "path string, exists boolean, is_file boolean, is_closed boolean, policy string")
    files = files.withColumn("length", F.when(F.col("path") == "/w/empty", 0).otherwise(5))
    for screen in (False, True):
        got = {r["path"]: r for r in audit_files(files, groups, frame(spark, cells), {"rs": policy}, screen).collect()}
        assert {p: r["status"] for p, r in got.items()} == {
            "/w/f": -1, "/w/short": -1, "/w/none": 1, "/w/dir": 1, "/w/open": 1, "/w/plain": 1, "/w/empty": 0,
            "/w/bare": 1, "/w/unread": 1, "/w/odd": 1}
        assert got["/w/bare"]["msg"] == got["/w/unread"]["msg"] == parity.NOT_READ and "unknown policy" in got["/w/odd"]["msg"]
        assert (got["/w/f"]["bad_host"], got["/w/f"]["bad_block"]) == ("10.0.0.4", 3)
        assert got["/w/short"]["msg"].endswith("under-erasure-coded.") and got["/w/short"]["bad_host"] is None
        assert got["/w/none"]["msg"] == "File /w/none does not exist."


def test_every_path_gets_a_status(spark):
    paths = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    one = spark.createDataFrame([("a", 0, None), ("b", 1, "x"), ("z", -1, "?")], "path string, status int, msg string")
    two = spark.createDataFrame([("a", -1, "bad"), ("b", 0, None)], "path string, status int, msg string")
    got = {r["path"]: (r["status"], r["msg"]) for r in verdict.file_status(paths, one, two).collect()}
    assert got == {"a": (-1, "bad"), "b": (0, None), "c": (1, verdict.NOT_CHECKED)}
    assert verdict.damaged_only(one).count() == 1


def test_sums_of_many_short_cells_are_those_of_each():
    policies = (Policy(6, 3, cell_size=16), Policy(2, 1, "xor", 16))
    rng = np.random.default_rng(8)
    unit, size = rng.integers(0, 9, 500), rng.integers(0, 41, 500)
    data = rng.integers(0, 256, int(size.sum()), np.uint8)
    of, ends = [parity._linear_sums(p) for p in policies], np.cumsum(size)
    want = [[x for sums in of for x in sums(int(u), data[e - n : e].tobytes()[::-1])] for u, n, e in zip(unit, size, ends)]
    assert parity._short_sums(policies, unit, data, size).tolist() == want


def test_short_and_long_cells_give_the_same_packs():
    """Cells of 16 bytes are copied at once, those of 200 one by one; of some stripes units are missing or short."""
    rng = np.random.default_rng(9)
    for width in (16, 200):
        rows = [(g, s, u, rng.bytes(int(rng.integers(0, width + 1)) if u == 2 else width)) for g in range(30) for s in range(2) for u in range(5) if rng.random() < 0.8]
        batch = pa.RecordBatch.from_pylist([dict(zip(("group_id", "stripe_no", "unit_index", "payload"), r)) for r in rows], pa.schema([("group_id", pa.int64()), ("stripe_no", pa.int32()), ("unit_index", pa.int32()), ("payload", pa.binary())]))
        seen = {}
        for pack, _ in parity.packs(iter([batch.slice(0, 77), batch.slice(77)]), 5):
            for i, (g, s) in enumerate(zip(pack.group_id.tolist(), pack.stripe_no.tolist())):
                seen |= {(g, s, u): pack.units[u, pack.starts[i] : pack.starts[i] + pack.sizes[i, u]].tobytes() for u in range(5) if pack.sizes[i, u] >= 0}
        assert seen == {r[:3]: r[3] for r in rows}


def test_checksums_name_the_units_without_moving_payloads(spark, monkeypatch):
    """Stripes of a code of 70 units, wherever their cells lie: what differs is known from the screen alone."""
    policy, rng = Policy(66, 4, cell_size=8), np.random.default_rng(12)
    cells = spark.createDataFrame([(g, 0, u, rng.bytes(8)) for g in range(6) for u in range(66)], "group_id long, stripe_no int, unit_index int, payload binary")
    hit = F.expr("group_id = 1 and unit_index in (66, 69) or group_id = 2 and unit_index = 65")
    coded = parity.encode(cells, policy, keep=True).withColumn("payload", F.when(hit, F.unhex(F.lit("00" * 8))).otherwise(F.col("payload")))
    coded = spark.createDataFrame(coded.collect(), cells.schema).repartition(7, "unit_index")
    exact = sorted(map(tuple, parity.audit_parity(coded, policy).collect()))
    monkeypatch.setattr(parity, "by_stripe", None)
    got = sorted(map(tuple, parity.audit_parity(coded, policy, screen=True).collect()))
    assert got == exact and [b for _, _, b in got] == [[], [0, 3], [0, 1, 2, 3], [], [], []]


def test_damaged_only_is_the_verdict_of_damaged_groups(spark):
    """The shorter verdict against the whole one: damaged, under-coded, unread and sound groups."""
    policy = Policy(3, 2)
    cells = coded(policy, 5)
    flip(cells, 1, 1, 0, 2)
    flip(cells, 2, 0, 4, 3)
    held = units(spark, {-g: f"/f{g}" for g in range(7)}, policy, size=3 * policy.k << 20).where("not (group_id = -3 and unit_index > 1)")
    stripes = parity.audit_parity(frame(spark, cells), policy)
    whole = parity.group_verdict(stripes, held, policy).where("status = -1")
    short = parity.group_verdict(stripes, held, policy, damaged_only=True)
    assert short.schema == whole.schema or [f.dataType for f in short.schema] == [f.dataType for f in whole.schema]
    got = sorted(map(str, short.collect()))
    assert got == sorted(map(str, whole.collect())) and {r["group_id"] for r in short.collect()} == {-1, -2, -3}


def test_attempts_by_units_are_those_by_hosts(spark):
    """Hosts that hold several units or none, a named host the group doesn't have, files without a named host."""
    policy, rows = Policy(3, 2), []
    for g, hosts in enumerate((["a", "b", "c", "d", "e"], ["b", "a", "b", "c", None], ["a"], ["e", "d", "c", "b", "a"])):
        rows += [(f"/f{g % 2}", g, u, h) for u, h in enumerate(hosts)]
    held = spark.createDataFrame(rows, "path string, group_id bigint, unit_index int, host string")
    told = "Status: ERROR, message: EC compute result not match.:ip is {} block is : -7"
    hurt = [("/f0", 0, told.format("c")), ("/f1", 1, told.format("b")), ("/f0", 2, told.format("z")), ("/f1", 3, None)]
    damaged = spark.createDataFrame(hurt, "path string, group_id bigint, msg string")
    by_hosts = attempt_units(recovery.plan_group_attempts(damaged, recovery.hosts_of_groups(held)), held)
    by_units = recovery.plan_unit_attempts(damaged, held)
    assert sorted(map(tuple, by_units.collect())) == sorted(map(tuple, by_hosts.collect())) and by_units.count() == 11 + 4 + 1 + 10


def test_attempts_move_no_payload_of_sound_groups(spark):
    """Many unit sets, more than a word of bits holds: fits as from rebuilding; screened sums of a batch fold per stripe."""
    policy = Policy(10, 4)
    cells = coded(policy, 3, seed=4, size=300)
    for s, u in enumerate((2, 9)):
        flip_many(cells, 1, s, u, 7)
    sets = [e for size in (1, 2) for e in itertools.combinations(range(14), size)]
    rows = [("/f", -g, n, list(e)) for g in range(3) for n, e in enumerate(sets, 1)]
    asked = spark.createDataFrame(rows, "path string, group_id bigint, attempt_no int, excluded array<int>")
    fits = {(r["group_id"], tuple(r["excluded"])) for r in try_attempts(frame(spark, cells), asked, policy).where("fits").collect()}
    assert len(sets) > 64 and {e for g, e in fits if g == -1} == {(2, 9)}
    assert {e for g, e in fits if g == 0} == set(sets)


@pytest.mark.parametrize("policy", POLICIES, ids=str)
def test_stripes_as_rows(spark, conf, policy):
    """Rows of payloads, some missing, short or empty, give the cells that the shuffled encoder gives, and move nothing."""
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    cells = {key: value for key, value in coded(policy, 6, seed=3).items() if key[2] < policy.k}
    stripes = sorted({key[:2] for key in cells})
    rows = [(g, s, [cells[g, s, u] if (g, s, u) in cells else None for u in range(policy.k)]) for g, s in stripes]
    rows.append((9, 0, [bytearray(b"")] + [None] * (policy.k - 1)))
    rows.append((9, 1, [None] * policy.k))  # nothing there: no stripe
    data = frame(spark, {**cells, (9, 0, 0): b""})
    wide = parity.encode_rows(spark.createDataFrame(rows, "group_id bigint, stripe_no int, payloads array<binary>"), policy)
    assert as_dict(wide) == as_dict(parity.encode(data, policy, keep=True)) and wide.count() == (len(rows) - 1) * policy.m + len(cells) + 1
    assert "Exchange" not in wide._jdf.queryExecution().toString()


def test_rendered_stripes_are_the_rendered_cells(spark):
    from workload import inputs

    d = "/root/testdata/sf0.001"
    wide = as_dict(parity.encode_rows(inputs.data_stripes(spark, d), inputs.RS))
    assert wide == as_dict(parity.encode(inputs.data_cells(spark, d), inputs.RS, keep=True)) and len(wide) > 9000


@pytest.mark.parametrize("screen", [False, True])
def test_only_bad_stripes(spark, screen):
    """The bad stripes of the whole audit; equal repeats are no damage, and a screen writes no sound stripe."""
    policy = Policy(3, 2)
    cells = coded(policy, 4)
    flip(cells, 1, 1, 0, 2)
    again = frame(spark, {(0, 1, 0): cells[0, 1, 0], (-2, 1, 1): b"another"})
    df = frame(spark, cells).unionByName(again)
    got = parity.audit_parity(df, policy, screen=screen, bad_only=True)
    assert bad_stripes(got) == bad_stripes(parity.audit_parity(df, policy)) == {(-1, 1): [0, 1], (-2, 1): [0, 1]} and got.count() == 2
