from __future__ import annotations

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from lakecheck.operators.filecheck import probe_readable
from lakecheck.operators.parity import Policy
from lakecheck.operators.textcheck import check_text_files
from lakecheck.plans.audit import audit_unit_files
from lakecheck.sources import tables, units
from lakecheck.sources.files import with_table

from test_parity import coded, flip

REGISTRY = "`table` string, format string, n_cols int, sep string"


def listed(spark, paths):
    return spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in paths], "path string, length bigint")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10**6])
def test_ranges_give_every_line_once(spark, tmp_path, size):
    rng, want = random.Random(size), {}
    for n in range(6):
        data = b"".join(rng.choice([b"\n", b"\r", b"\r\n", b"a", b"bc", "é漢".encode(), b"\xff"]) for _ in range(rng.choice([0, 1, 5, 60])))
        (tmp_path / f"f{n}").write_bytes(data)
        lines = re.split("\r\n|\r|\n", data.decode("utf-8", "replace"))
        want[f"file:{tmp_path / f'f{n}'}"] = lines[:-1] if lines[-1] == "" else lines
    got = {}
    rows = tables.read_text_lines(listed(spark, sorted(tmp_path.iterdir())), range_bytes=size, piece=max(1, size // 2)).collect()
    for r in sorted(rows, key=lambda r: (r["path"], r["block_start"], r["row_pos"])):
        assert r["error"] is None
        got.setdefault(r["path"], []).append(r["value"])
    assert got == {p: lines for p, lines in want.items() if lines}


def test_a_broken_text_file_leaves_the_others_alone(spark, tmp_path):
    base = tmp_path / "x.db" / "t0"
    base.mkdir(parents=True)
    good = "".join(f"{i}\ta\tb\tc\td\n" for i in range(500)).encode()
    for n in range(40):
        (base / f"f{n}").write_bytes(good if n else good + b"1\tx\n")
    (base / "whole.gz").write_bytes(gzip.compress(good))
    (base / "cut.gz").write_bytes(gzip.compress(good)[:-30])
    (base / "empty").write_bytes(b"")
    files = listed(spark, sorted(base.iterdir())).unionByName(spark.createDataFrame([(f"file:{base}/gone", 9)], "path string, length bigint"))
    registry = spark.createDataFrame([("t0", "text", 5, "\t")], REGISTRY)
    got = {r["path"].rsplit("/", 1)[1]: r for r in probe_readable(with_table(files), registry).collect()}
    assert {n: r["status"] for n, r in got.items() if r["status"]} == {"f0": -1, "cut.gz": -1, "gone": 1} and len(got) == 44
    assert got["f0"]["msg"].endswith("line 501") and got["cut.gz"]["msg"].startswith("EOFError") and got["gone"]["msg"].startswith(tables.NOT_OPENED)
    checked = {r["path"].rsplit("/", 1)[1]: r["n_rows"] for r in check_text_files(with_table(files), registry).collect()}
    assert checked["f1"] == checked["whole.gz"] == 500 and checked["empty"] == checked["gone"] == 0


def test_parts_read_as_one_file(spark, tmp_path):
    rng = random.Random(2)
    data = {n: rng.randbytes(n) for n in (1, 99, 100, 101, 2500)}
    pieces, want = [], {}
    for n, content in data.items():
        target, at = f"{tmp_path}/x.db/t/f{n}{tables.PARTS}", 0
        whole = bytearray(content)
        while at < n:
            step = rng.choice([1, 10, 33, 250])
            if rng.random() < 0.2 and n > 1:
                whole[at : at + step] = bytes(len(whole[at : at + step]))  # a piece that nobody has
            else:
                pieces.append((target, at, bytearray(content[at : at + step])))
            at += step
        pieces.append((target, n + 5, bytearray(b"beyond")))
        want[target] = bytes(whole)
    targets = spark.createDataFrame([(t, len(w)) for t, w in want.items()], "target string, length bigint")
    df = spark.createDataFrame(pieces, "target string, at bigint, payload binary")
    for _ in range(2):  # a task that runs again finds the part there
        written = units.write_parts(df.repartition(3), targets, part_bytes=100).collect()
        assert len(written) == sum(-(-len(w) // 100) for w in want.values()) and max(r["length"] for r in written) == 100
    for target, content in want.items():
        with tables.open_path(target) as handle:
            assert handle.read() == content
            handle.seek(len(content) // 2)
            assert handle.read(120) == content[len(content) // 2 :][:120]
    with pytest.raises(FileNotFoundError):
        tables.open_path(f"{tmp_path}/none{tables.PARTS}")


def unit_rows(spark, tmp_path, cells, policy, n_groups, size=40):
    rows = []
    for g in range(n_groups):
        for u in range(policy.n):
            path = tmp_path / f"g{g}-u{u}"
            path.write_bytes(b"".join(cells.get((-g, s, u), b"").ljust(size, b"\0") for s in range(3)))
            rows.append((f"file:{path}", path.stat().st_size, -g, u, size))
    return spark.createDataFrame(rows, "path string, length bigint, group_id bigint, unit_index int, cell_size int")


def test_cells_of_unit_files(spark, tmp_path):
    policy = Policy(3, 2, cell_size=40)
    cells = coded(policy, 2)
    files = unit_rows(spark, tmp_path, cells, policy, 2)
    for step in (1, 40, 80, 10**6):
        rows = units.scan_unit_cells(files, range_bytes=step).collect()
        assert all(r["error"] is None and len(r["payload"]) == 40 for r in rows) and len(rows) == 30
        assert all(bytes(r["payload"]) == cells.get((r["group_id"], r["stripe_no"], r["unit_index"]), b"").ljust(40, b"\0") for r in rows)
    (tmp_path / "g0-u1").write_bytes(b"x" * 50)
    (tmp_path / "g1-u0").unlink()
    bad = {(r["group_id"], r["unit_index"]): r["error"] for r in units.scan_unit_cells(files).where("error is not null").collect()}
    assert bad[0, 1] == units.ENDED and bad[-1, 0].startswith(tables.NOT_OPENED) and len(bad) == 2
    part = [bytes(r["payload"]) for r in units.scan_unit_cells(files).where("group_id = 0 and unit_index = 1 and error is null").orderBy("stripe_no").collect()]
    assert b"".join(part) == b"x" * 50
    assert {r["group_id"] for r in units.unread_groups(files).collect()} == {0, -1}
    assert units.scan_unit_cells(files.limit(0)).count() == 0


def test_audit_of_unit_files(spark, tmp_path):
    policy = Policy(3, 2, cell_size=40)
    cells = coded(policy, 5)
    flip(cells, 1, 1, 4, 2)
    flip(cells, 2, 0, 1, 2)
    files = unit_rows(spark, tmp_path, cells, policy, 5)
    (tmp_path / "g3-u0").unlink()
    (tmp_path / "g2-u3").write_bytes((tmp_path / "g2-u3").read_bytes()[:70])  # broke off, and damaged
    held = files.select("group_id", F.concat(F.lit("/w/f"), (-F.col("group_id")).cast("string")).alias("path"), "unit_index", F.lit("h").alias("host"), F.lit(3 * 3 * 40).alias("group_size"))
    meta = held.select("path").distinct().selectExpr("path", "true as exists", "true as is_file", "true as is_closed", "'rs' as policy", "1 as length")
    got = {r["path"]: r["status"] for r in audit_unit_files(meta, held, files, {"rs": policy}).collect()}
    assert got == {"/w/f0": 0, "/w/f1": -1, "/w/f2": 1, "/w/f3": 1, "/w/f4": 0}


def test_a_short_file_is_opened_once(spark, tmp_path, monkeypatch):
    """All ranges of a short file come to the same task, which reads them as one."""
    policy = Policy(3, 2, cell_size=40)
    files = unit_rows(spark, tmp_path, coded(policy, 8), policy, 8)
    dealt = units.scan_unit_cells(files, range_bytes=40).withColumn("task", F.spark_partition_id())
    per_file = dealt.groupBy("group_id", "unit_index").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n")).collect()
    assert len(per_file) == 40 and {(r["tasks"], r["n"]) for r in per_file} == {(1, 3)}
    opened, real = [], units.open_path
    monkeypatch.setattr(units, "open_path", lambda path: opened.append(path) or real(path))
    names = ("path", "group_id", "unit_index", "cell_size", "start", "end")
    path = files.first()["path"]
    ranges = units.pa.RecordBatch.from_pylist([dict(zip(names, (path, 0, 0, 40, at, at + 40), strict=True)) for at in (0, 40, 80)])
    got = list(units._cells(iter([ranges.slice(0, 2), ranges.slice(2)])))
    assert opened == [path] and len(got) == 1 and got[0].column("stripe_no").to_pylist() == [0, 1, 2]


def test_pieces_by_number(spark, tmp_path, conf):
    """Pieces name their file by a number, some past its end, across it or of no file; nothing is joined."""
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    targets = [(n, f"{tmp_path}/f{n}{tables.PARTS}", n * 30) for n in range(4)]
    pieces = [(n, at, bytearray([n + 1]) * 20) for n in range(6) for at in (0, 25, 50, 75, 200)]
    written = units.write_parts(spark.createDataFrame(pieces, "no bigint, at bigint, payload binary").repartition(4), spark.createDataFrame(targets, "no bigint, target string, length bigint"), part_bytes=40, key="no")
    assert "Join" not in written._jdf.queryExecution().toString()
    assert {(r["target"], r["part"]): r["length"] for r in written.collect()} == {(t, p): min(40, n - p * 40) for _, t, n in targets for p in range(max(-(-n // 40), 1))}
    for n, target, length in targets:
        whole = bytearray(length)
        for at in (0, 25, 50, 75):
            whole[at : at + 20] = (bytes([n + 1]) * 20)[: max(length - at, 0)]
        with tables.open_path(target) as handle:
            assert handle.read() == bytes(whole[:length])
