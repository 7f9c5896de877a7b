from __future__ import annotations

import gzip
import os
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from lakecheck.operators import compaction, filecheck, orcstats, textcheck
from lakecheck.operators.apart import Apart, Crash
from lakecheck.plans.compaction import compact_table
from lakecheck.sources import files, sinks, tables

N = 200_000


def sample(n: int = N) -> pa.Table:
    rng = np.random.default_rng(3)
    return pa.table({"id": np.arange(n), "x": rng.integers(0, 1 << 40, n), "s": [f"row {i % 977}" for i in range(n)]})


def damage(path: Path, at: float = 0.5, n: int = 2000) -> None:
    data = bytearray(path.read_bytes())
    start = int(len(data) * at)
    data[start : start + n] = bytes(255 - b for b in data[start : start + n])
    path.write_bytes(bytes(data))


def cut(path: Path) -> None:
    path.write_bytes(path.read_bytes()[: path.stat().st_size // 2])


def verdicts(df) -> dict[str, int]:
    return {os.path.basename(r["path"]): r["status"] for r in df.collect()}


@pytest.fixture
def parquet_dir(tmp_path):
    table = sample()
    for name in ("good", "cut", "middle", "late"):
        pq.write_table(table, tmp_path / name, row_group_size=50_000, compression="snappy")
    pq.write_table(table, tmp_path / "sums", compression="none", use_dictionary=False, write_page_checksum=True)
    pq.write_table(sample(0), tmp_path / "empty")
    cut(tmp_path / "cut")
    damage(tmp_path / "middle", 0.1)
    damage(tmp_path / "late", 0.9)
    damage(tmp_path / "sums", 0.3, 1)
    (tmp_path / "garbage").write_bytes(b"not a table")
    return tmp_path


def test_inventory(spark, tmp_path):
    for name in ("x.db/t/p0", "x.db/t/d=1/p1", "x.db/t/_SUCCESS", "x.db/t/.hidden", "y.db/u/empty", "loose"):
        put(tmp_path / name, b"" if name.endswith("empty") else b"abc")
    (tmp_path / "nothing here").mkdir()
    seen = {r["path"].rsplit(str(tmp_path))[1]: r for r in files.scan_all_files(spark, str(tmp_path)).collect()}
    assert set(seen) == {"/x.db/t/p0", "/x.db/t/d=1/p1", "/x.db/t/_SUCCESS", "/x.db/t/.hidden", "/y.db/u/empty", "/loose"}
    assert (seen["/y.db/u/empty"]["length"], seen["/y.db/u/empty"]["db"], seen["/loose"]["db"]) == (0, "y", None)
    plain = {r["path"].rsplit(str(tmp_path))[1]: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert set(plain) == {"/x.db/t/p0", "/x.db/t/d=1/p1", "/loose"}
    for path, row in plain.items():
        assert (row["length"], row["table"]) == (seen[path]["length"], seen[path]["table"])
        assert abs((row["modification_time"] - seen[path]["modification_time"]).total_seconds()) < 1


def test_folders_that_cannot_be_listed(spark, tmp_path):
    put(tmp_path / "x.db/t/p0", b"abc")
    (tmp_path / "x.db/t/dangling").symlink_to(tmp_path / "gone")
    roots = [str(tmp_path / "x.db"), str(tmp_path / "missing"), str(tmp_path / "x.db/t/p0")]
    found, unlisted = files.list_all(spark, *roots)
    assert {(r["path"].rsplit("/", 1)[1], r["length"]) for r in found.collect()} == {("p0", 3), ("dangling", None)}
    seen = {r["path"].rsplit("/", 1)[1]: r["error"] for r in unlisted.collect()}
    assert set(seen) == {"missing", "p0"} and all(e.startswith(tables.NOT_OPENED) for e in seen.values())
    with pytest.raises(OSError):
        files.scan_all_files(spark, *roots)


def test_folders_are_listed_in_pages(tmp_path):
    for i in range(25):
        (tmp_path / f"f{i}").write_bytes(b"x" * i)
    pages = list(tables.list_folder(str(tmp_path), 10))
    assert [len(p) for p in pages] == [10, 10, 5]
    assert {(path.rsplit("/f")[-1], length) for p in pages for path, length, _, _ in p} == {(str(i), i) for i in range(25)}


def test_check_parquet(spark, parquet_dir):
    found = files.scan_files(spark, str(parquet_dir))
    full = filecheck.check_parquet(found)
    assert verdicts(full) == {"good": 0, "empty": 0, "cut": -1, "middle": -1, "late": -1, "sums": -1, "garbage": -1}
    good = full.where("path like '%/good'").first()
    assert (good["n_rows"], good["n_units"]) == (N, 4)


def test_large_row_groups_are_read_by_column(parquet_dir, monkeypatch):
    monkeypatch.setattr(filecheck, "BYTES_PER_TASK", 100_000)
    with tables.open_path(str(parquet_dir / "good")) as handle:
        file = filecheck._Parquet(handle)
        assert file.units == 12 and sum(file.read(u) for u in range(file.units)) == N
    with tables.open_path(str(parquet_dir / "middle")) as handle:
        file, failed = filecheck._Parquet(handle), 0
        for unit in range(file.units):
            try:
                file.read(unit)
            except filecheck._PROBLEMS:
                failed += 1
        assert 1 <= failed <= 3


def test_nested_columns(spark, tmp_path):
    table = pa.table({"a": [[1, 2], None, []], "b": [{"x": 1, "y.z": "q"}] * 3, "m": pa.array([[("k", 1)]] * 3, pa.map_(pa.string(), pa.int32()))})
    pq.write_table(table, tmp_path / "nested")
    assert verdicts(filecheck.check_parquet(files.scan_files(spark, str(tmp_path)))) == {"nested": 0}


def test_missing_file_is_reported(spark, tmp_path):
    gone = spark.createDataFrame([(str(tmp_path / "gone"),)], "path string")
    row = filecheck.check_parquet(gone).first()
    assert row["status"] == 1 and row["msg"].startswith(tables.NOT_OPENED) and "FileNotFound" in row["msg"]
    registry = spark.createDataFrame([("z", "text_gzip", 3, "\t")], "`table` string, format string, n_cols int, sep string")
    lost = spark.createDataFrame([(str(tmp_path / "x.db/z/gone.gz"), "z")], "path string, table string")
    row = textcheck.check_gzip_delimited(lost, registry).first()
    assert row["status"] == 1 and row["msg"].startswith(tables.NOT_OPENED)


def test_keys_are_taken_as_they_are(spark, tmp_path):
    name = "a %41#b?c+d e"
    pq.write_table(sample(10), tmp_path / name)
    assert {k: v for k, v in verdicts(filecheck.check_parquet(files.scan_all_files(spark, str(tmp_path)))).items()} == {name: 0}


def test_check_orc(spark, tmp_path):
    for name in ("good", "cut", "middle"):
        orc.write_table(sample(), str(tmp_path / name), compression="zlib", stripe_size=1 << 18)
    orc.write_table(sample().slice(0, 0), str(tmp_path / "empty"))
    cut(tmp_path / "cut")
    damage(tmp_path / "middle")
    checked = filecheck.check_orc(files.scan_files(spark, str(tmp_path)))
    assert verdicts(checked) == {"good": 0, "cut": -1, "middle": -1, "empty": 0}
    assert checked.where("path like '%/good'").first()["n_units"] > 1


@pytest.fixture
def registry(spark):
    rows = [("t", "text", 3, "\x01"), ("z", "text_gzip", 3, "\t"), ("p", "parquet", None, None)]
    return spark.createDataFrame(rows, "`table` string, format string, n_cols int, sep string")


def put(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_text_verdict_with_line_numbers_over_splits(spark, conf, tmp_path, registry):
    line = b"a\x01b\x01c\n"
    put(tmp_path / "x.db/t/good", line * 4000 + b"\n  \n" + b"a\x01b\n")
    put(tmp_path / "x.db/t/late bad+", line * 3210 + b"a\x01b\x01c\x01d\n" + line * 700 + b"\x01\x01\n")
    put(tmp_path / "x.db/t/first", b"\x01\x01\n" + line * 10)
    put(tmp_path / "x.db/u/unknown", line)
    conf("spark.sql.files.maxPartitionBytes", "4096")
    conf("spark.sql.files.openCostInBytes", "1")
    rows = textcheck.check_delimited(tables.scan_text_rows(spark, str(tmp_path)), registry)
    assert rows.rdd.getNumPartitions() > 5
    got = {os.path.basename(r["path"]): r for r in textcheck.text_verdict(rows).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": 0, "late bad+": -1, "first": -1, "unknown": 1}
    late = got["late bad+"]
    assert (late["first_bad_line"], late["n_bad"], late["n_rows"], late["first_bad"]) == (3211, 2, 3912, "a\x01b\x01c\x01d")
    assert got["first"]["first_bad_line"] == 1 and got["unknown"]["msg"] == textcheck.NO_ENTRY
    assert (late["bad_fields"], got["first"]["bad_fields"], got["good"]["bad_fields"]) in [(0, 0, None), (4, 0, None)]
    whole = textcheck.check_text_tables(spark, [(f"{tmp_path}/x.db/t", 3, "\x01"), (f"{tmp_path}/x.db/u", None, None)])
    assert {r["path"]: r for r in textcheck.text_verdict(whole).collect()} == {r["path"]: r for r in got.values()}


def test_gzip_text(spark, tmp_path, registry):
    line, folder = b"a\tb\tc\n", tmp_path / "x.db/z"
    whole = gzip.compress(line * 50_000)
    put(folder / "plain_name", whole)
    put(folder / "members.gz", gzip.compress(line * 3) + gzip.compress(line + b"a\tb\tc\td\n"))
    noise = b"".join(b"%d\tb\tc\n" % (i * i) for i in range(400_000))
    put(folder / "half.gz", gzip.compress(noise)[: len(whole) // 2 + (1 << 20)])
    put(folder / "not_gzip", line * 5)
    put(folder / "nothing", gzip.compress(b""))
    put(folder / "windows", gzip.compress(b"a\tb\tc\r\na\tb\tc\r\rlast\tb"))
    checked = textcheck.check_gzip_delimited(files.scan_files(spark, str(tmp_path)), registry)
    got = {os.path.basename(r["path"]): r for r in checked.collect()}
    expected = {"plain_name": 0, "members.gz": -1, "half.gz": -1, "not_gzip": -1, "nothing": 0, "windows": -1}
    assert {k: r["status"] for k, r in got.items()} == {**expected, "windows": 0}
    assert got["plain_name"]["n_rows"] == 50_000 and got["members.gz"]["first_bad_line"] == 5
    assert "EOFError" in got["half.gz"]["msg"] and got["half.gz"]["n_rows"] > 0
    assert got["windows"]["n_rows"] == 4


def test_gzip_line_ends_over_pieces():
    text = "a\r\nb\rc\n\nd\r"
    for size in range(1, 6):
        pieces = (text[i : i + size] for i in range(0, len(text), size))
        assert [line for lines in tables._lines_of(pieces) for line in lines] == ["a", "b", "c", "", "d"]


def test_probe_routes_by_table(spark, tmp_path, registry):
    (tmp_path / "x.db/p").mkdir(parents=True)
    (tmp_path / "x.db/o").mkdir()
    pq.write_table(sample(10), tmp_path / "x.db/p/good")
    orc.write_table(sample(10), str(tmp_path / "x.db/o/good.orc"))
    put(tmp_path / "x.db/o/bad.orc", b"ORC?")
    put(tmp_path / "x.db/t/good.txt", b"a\x01b\x01c\n")
    put(tmp_path / "x.db/t/empty.txt", b"")
    put(tmp_path / "x.db/z/bad.gz", b"a\tb\tc\n")
    put(tmp_path / "x.db/t/bad row.txt", b"a\x01b\x01c\nlonely\x01x\x01y\x01z\n")
    put(tmp_path / "x.db/o/_SUCCESS", b"")
    put(tmp_path / "x.db/t/.hidden.txt", b"a\x01b\n")
    expected = {
        ("good", "parquet"): 0, ("good.orc", "orc"): 0, ("bad.orc", "orc"): -1, ("bad row.txt", "text"): -1,
        ("good.txt", "text"): 0, ("empty.txt", "text"): 0, ("bad.gz", "text_gzip"): -1, ("_SUCCESS", "orc"): 1, (".hidden.txt", "text"): 1,
    }
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}"):  # all forms of a local path
        seen = filecheck.probe_readable(files.scan_all_files(spark, root), registry)
        assert {(os.path.basename(r["path"]), r["format"]): r["status"] for r in seen.collect()} == expected
    listed = filecheck.probe_readable(files.scan_files(spark, str(tmp_path)), registry)
    got = {(os.path.basename(r["path"]), r["format"]): r["status"] for r in listed.collect()}
    assert got == {k: v for k, v in expected.items() if k[0] not in ("empty.txt", "_SUCCESS", ".hidden.txt")}


@pytest.mark.parametrize(
    "n_bytes, codec, n",
    [(1, "gzip", 1), (512 << 20, "gzip", 1), (513 << 20, "gzip", 1), (3 << 30, "gzip", 2), (30 << 30, "bzip2", 2), (6 << 30, "bzip2", 1)],
)
def test_compaction_files(spark, n_bytes, codec, n):
    got = spark.range(1).select(compaction.compaction_files(F.lit(n_bytes).cast("bigint"), codec).alias("n"))
    assert got.first()["n"] == n


def test_compaction_keeps_the_bag_and_spreads_hot_lines(spark, tmp_path):
    lines = [f"line {i % 50}" if i % 3 else "hot" for i in range(6000)] + ["", " x "]
    (tmp_path / "in").mkdir()
    for part in range(3):
        (tmp_path / "in" / f"f{part}.txt").write_text("\n".join(lines[part::3]) + "\n")
    compacted = compaction.compact_text(tables.scan_small_text(spark, str(tmp_path / "in")), 6)
    sinks.write_compressed(compacted, str(tmp_path / "out"), "gzip")
    outputs = list((tmp_path / "out").glob("*.txt.gz"))
    contents = [gzip.decompress(f.read_bytes()).decode().split("\n")[:-1] for f in outputs]
    assert Counter(line for c in contents for line in c) == Counter(lines)
    assert all(c == sorted(c) for c in contents) and len(outputs) == 6
    assert sum("hot" in c for c in contents) >= 2
    done = compact_table(spark, str(tmp_path / "in"), str(tmp_path / "out"), "bzip2")
    assert done.n_files == 1 and done.whole and done.n_lines == spark.read.text(str(tmp_path / "in")).count()
    back = Counter(r["value"] for r in tables.scan_small_text(spark, str(tmp_path / "out")).collect())
    assert back == Counter(lines)


def test_values_outside_the_footer(spark, tmp_path):
    """Bytes changed in a page without compression and checksum decode to other values."""

    n = 5000
    table = pa.table({
        "k": pa.array(range(1000, 1000 + n), pa.int64()), "f": pa.array([float(i % 7) + 1 if i % 9 else None for i in range(n)]), "s": pa.array([f"s{i}" for i in range(n)]),
        "nan": pa.array([float("nan")] * n), "none": pa.array([None] * n, pa.int32()), "l": pa.array([[i] for i in range(n)]), "t": pa.array(range(n), pa.timestamp("us")), "u": pa.array([2**32 - 1 - i % 5 for i in range(n)], pa.uint32()),
    })
    for name in ("good", "key", "small"):
        pq.write_table(table, tmp_path / name, compression="none", use_dictionary=False, row_group_size=2000)
    data = (tmp_path / "key").read_bytes()
    at = data.index((1500).to_bytes(8, "little"))
    (tmp_path / "key").write_bytes(data[:at] + b"\xff" * 7 + b"\x7f" + data[at + 8 :])
    (tmp_path / "small").write_bytes(data[:at] + (1600).to_bytes(8, "little") + data[at + 8 :])  # within the range: not seen
    files = spark.createDataFrame([(str(tmp_path / n), 1000) for n in ("good", "key", "small")], "path string, length bigint")
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["msg"]) for r in filecheck.check_parquet(files).collect()}
    assert got["good"] == (0, None) and got["small"][0] == 0
    assert got["key"][0] == -1 and "leave the range" in got["key"][1]


def test_orc_values_are_compared_with_statistics(spark, tmp_path):
    """Bytes stored as they are decode to other values when overwritten; statistics tell."""
    rng = np.random.default_rng(4)
    table = pa.table({
        "x": rng.random(20_000), "s": [f"{v:08x}" for v in rng.integers(0, 1 << 32, 20_000)], "n": rng.integers(-(1 << 60), 1 << 60, 20_000),
        "b": rng.random(20_000) < 0.3, "t": pa.array(rng.integers(0, 1 << 50, 20_000), pa.timestamp("us")), "d": pa.array(rng.integers(0, 9000, 20_000).astype("int32"), pa.date32()),
        "f": pa.array([None if i % 7 == 0 else i / 3 for i in range(20_000)], pa.float32()), "nan": [float("nan"), *rng.random(19_999)], "y": [b"ab" * (i % 3) for i in range(20_000)], "l": [[i] for i in range(20_000)]})
    for codec in ("uncompressed", "zlib", "snappy", "zstd"):
        orc.write_table(table, str(tmp_path / codec), compression=codec, stripe_size=1 << 17)
    spark.createDataFrame([(i, i / 7, f"v{i}", i % 3 == 0) for i in range(5000)], "a long, b double, c string, e boolean").selectExpr("*", "current_date() AS d", "timestamp_seconds(a) AS t").coalesce(1).write.orc(str(tmp_path / "spark"))
    assert {r.status for r in filecheck.check_orc(files.scan_files(spark, str(tmp_path))).collect()} == {0}
    whole = (tmp_path / "uncompressed").read_bytes()
    at = whole.index(np.float64(table["x"][7].as_py()).tobytes())
    (tmp_path / "hurt").mkdir()
    (tmp_path / "hurt/one").write_bytes(whole[:at] + np.float64(0.5).tobytes() + whole[at + 8 :])
    where = whole.index(table["s"][9].as_py().encode())
    (tmp_path / "hurt/two").write_bytes(whole[:where] + b"~~~~" + whole[where + 4 :])
    found = filecheck.check_orc(files.scan_files(spark, str(tmp_path / "hurt"))).collect()
    assert [r.status for r in found] == [-1, -1] and all("statistics" in r.msg for r in found)


def test_compaction_bounds_what_a_task_writes(spark, tmp_path):
    """Far below the target size of a gzip file, yet no file holds more than a task's bytes, but for the sample of the ranges."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(20_000).selectExpr("concat('line ', id % 5000, ' ', repeat('x', 20)) AS value").write.text(source)
    done = compact_table(spark, source, out, task_bytes=100_000)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in Path(out).glob("*.gz")]
    assert done.whole and done.n_lines == 20_000 and len(sizes) == done.n_files > 5 and max(sizes) < 200_000


def test_lines_of_a_text_in_parts_are_numbered_through(spark, tmp_path):
    folder = tmp_path / "x.db/t0/p=1"
    folder.mkdir(parents=True)
    for number, lines in ((2, ["a\tb", "b\ta\td\te\tf"]), (10, ["also\tbad\tx\ty\tz\tz"]), (0, ["a\tb"] * 3)):
        (folder / f"part-{number:05d}-u.c000.txt").write_text("\n".join(lines) + "\n")
    rows = textcheck.check_text_tables(spark, [(str(tmp_path / "x.db/t0"), 2, "\t")])
    got = textcheck.text_verdict(textcheck.in_parts(rows)).collect()
    assert [(r.path.endswith("/p=1/"), r.n_rows, r.first_bad_line, r.first_bad) for r in got] == [(True, 6, 5, "b\ta\td\te\tf")]


def test_changed_copies_are_made_in_pieces(tmp_path, monkeypatch):
    """A file of many pieces: cut short, overwritten across pieces, or as it was; no read is larger than a piece."""
    data, reads = bytes(np.random.default_rng(9).integers(1, 256, 1000, np.uint8)), []
    (tmp_path / "whole").write_bytes(data)
    opened = tables.open_path

    class Watched:
        def __init__(self, handle):
            self.handle = handle

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.handle.close()

        def read(self, n):
            reads.append(n)
            return self.handle.read(n)

    monkeypatch.setattr(tables, "open_path", lambda path: Watched(opened(path)))
    rows = {"part": ["0", "1", "2"], "path": [str(tmp_path / "whole")] * 3, "end": [1000, 667, 1000], "zero_from": [0, 0, 250], "zero_to": [0, 0, 750]}
    (made,) = tables.copy_files(str(tmp_path / "out"), piece=64)(iter([pa.RecordBatch.from_pydict(rows)]))
    got = [Path(p.removeprefix("file:")).read_bytes() for p in made["path"].to_pylist()]
    assert got == [data, data[:667], data[:250] + bytes(500) + data[750:]] and max(reads) == 64
    assert made["length"].to_pylist() == [1000, 667, 1000] and len(list((tmp_path / "out").rglob("blob-*"))) == 3


def test_a_file_that_kills_its_reader_is_damaged(spark, tmp_path):
    """Every other 256 bytes overwritten, the tail too: pyarrow's ORC reader dies of it."""
    rng = np.random.default_rng(920)
    table = pa.table({"a": rng.integers(0, 10**9, 920), "b": [f"name {x}" for x in rng.integers(0, 10**6, 920)], "c": rng.random(920)})
    for name in ("good", "hurt", "last"):
        orc.write_table(table, tmp_path / name, compression="zstd")
    data = bytearray((tmp_path / "hurt").read_bytes())
    for at in range(256, len(data), 512):
        data[at : at + 256] = (b"x\n" * 128)[: len(data[at : at + 256])]
    (tmp_path / "hurt").write_bytes(bytes(data))
    found = {os.path.basename(r.path): r for r in filecheck.check_orc(files.scan_files(spark, str(tmp_path)).coalesce(1)).collect()}
    assert {n: r.status for n, r in found.items()} == {"good": 0, "hurt": -1, "last": 0}


def test_one_unit_that_kills_the_reader_leaves_the_others(spark, tmp_path):
    class Deadly:
        rows, units = 30, 3

        def __init__(self, handle):
            self.name = bytes(handle.read())

        def read(self, unit):
            if self.name == b"hurt" and unit == 1:
                os.kill(os.getpid(), 11)
            return 10

    for name in ("a", "hurt", "z"):
        (tmp_path / name).write_bytes(name.encode())
    found = {os.path.basename(r.path): r for r in filecheck._check(files.scan_files(spark, str(tmp_path)), Deadly).collect()}
    assert {n: r.status for n, r in found.items()} == {"a": 0, "hurt": -1, "z": 0}
    assert "SIGSEGV" in found["hurt"].msg and found["z"].n_units == 3


def test_a_reader_that_is_ended_from_outside_is_an_error():
    work = Apart(lambda signal: os.kill(os.getpid(), signal) if signal else os.getpid())
    with work, pytest.raises(RuntimeError, match="signal 9"):
        first = work(0)
        with pytest.raises(Crash):
            work(6)
        assert work(0) not in (first, os.getpid())
        work(9)


def test_unreadable_statistics_are_damage():
    with pytest.raises(ValueError, match="tail"):
        orcstats.differs(pa.array([1, 2]), {2: b"\x08\xff"})
