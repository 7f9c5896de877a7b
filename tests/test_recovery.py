from __future__ import annotations

from lakecheck.functions.messages import MISMATCH
from lakecheck.operators import recovery

NAMED = f"Status: ERROR, message: {MISMATCH}:ip is h2 block is : -7"


def test_five_hosts_give_ten_pairs_in_order(spark):
    df = spark.createDataFrame([("p", ["h0", "h1", "h2", "h3", "h4"]), ("q", ["a"]), ("r", [])], "path string, hosts array<string>")
    rows = recovery.host_pairs(df).orderBy("pair_no").collect()
    assert [r["pair_no"] for r in rows] == list(range(10)) and {r["path"] for r in rows} == {"p"}
    assert [tuple(r["pair"]) for r in rows] == [(f"h{i}", f"h{j}") for i in range(5) for j in range(i + 1, 5)]


def test_hosts_are_per_group(spark):
    rows = [("p", 1, "b"), ("p", 1, "a"), ("p", 1, "a"), ("p", 2, "c")]
    got = recovery.hosts_of_groups(spark.createDataFrame(rows, "path string, group_id bigint, host string"))
    assert {(r["group_id"], tuple(r["hosts"])) for r in got.collect()} == {(1, ("a", "b")), (2, ("c",))}


def plan(spark, force):
    damaged = spark.createDataFrame([("p", NAMED), ("q", "Block group is under-erasure-coded.")], "path string, msg string")
    hosts = spark.createDataFrame([("p", 1, ["h1", "h2", "h3"]), ("q", 2, ["h1", "h2"])], "path string, group_id bigint, hosts array<string>")
    attempts = recovery.plan_attempts(damaged, hosts, force)
    return sorted((r["path"], r["attempt_no"], tuple(r["excluded"])) for r in attempts.collect())


def test_plan_starts_with_the_suspect(spark):
    pairs = [("p", 1, ("h2",)), ("p", 2, ("h1", "h2")), ("p", 3, ("h1", "h3")), ("p", 4, ("h2", "h3"))]
    assert plan(spark, True) == [*pairs, ("q", 2, ("h1", "h2"))]
    assert plan(spark, False) == pairs


def test_first_success_wins(spark):
    rows = [("p", 7, 1, False), ("p", 7, 3, True), ("p", 7, 2, True), ("q", 8, 1, False), ("s", 1, 1, True), ("s", 2, 1, False), ("s", 2, 2, None)]
    attempts = spark.createDataFrame(rows, "path string, group_id bigint, attempt_no int, ok boolean")
    damaged = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "path string")
    best = {(r["path"], r["group_id"]): r["attempt_no"] for r in recovery.best_attempts(attempts).collect()}
    assert best == {("p", 7): 2, ("q", 8): None, ("s", 1): 1, ("s", 2): None}
    outcome = recovery.recovery_outcome(damaged, attempts)
    got = {r["path"]: (r["outcome"], r["n_groups"], r["n_recovered"]) for r in outcome.collect()}
    assert got == {"p": ("recovered", 1, 1), "q": ("failed", 1, 0), "r": ("failed", 0, 0), "s": ("failed", 2, 1)}  # one group of a file isn't the file
    assert sorted(r["path"] for r in recovery.unrecoverable(outcome).collect()) == ["q", "r", "s"]


def test_error_report_paths(spark):
    lines = [(f"a/b==={NAMED}",), ("c===Block group is under-erasure-coded.",), ("noise",)]
    got = recovery.parse_error_report(spark.createDataFrame(lines, "value string"), "EC compute result not match")
    assert [r["path"] for r in got.collect()] == ["a/b"]
