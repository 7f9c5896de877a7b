from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lakecheck.functions import logs, messages, paths, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def java_fields(line: str, sep: str) -> int:
    """Length of Java's ``line.split(sep)``: trailing empty parts do not count."""
    parts = line.split(sep)
    if len(parts) == 1:
        return 1
    while parts and not parts[-1]:
        parts.pop()
    return len(parts)


def test_field_count_follows_java(spark):
    rng = random.Random(7)
    rows = [("".join(rng.choice(["a", "bb", s, s]) for _ in range(rng.randrange(9))), s) for s in ("\t", "\x01", "||") * 60]
    rows += [("", "\t"), ("\x01\x01", "\x01"), ("\t", "\t"), ("a", "\t"), ("|a|", "||"), ("a|||", "||")]
    got = values(spark, rows, "v string, s string", text.field_count(F.col("v"), F.col("s")))
    assert [n for n, in got] == [java_fields(v, s) for v, s in rows]


@pytest.mark.parametrize(
    "n_cols, fine, bad",
    [(5, {3, 4, 5}, {0, 1, 2, 6, 9}), (9, {7, 8, 9}, {6, 10}), (10, {4, 9, 10, 25}, {0, 3}), (62, {56, 62, 63}, {55, 1})],
)
def test_fields_ok(spark, n_cols, fine, bad):
    rows = [(n,) for n in sorted(fine | bad)]
    got = values(spark, rows, "n int", "n", text.fields_ok(F.col("n"), F.lit(n_cols)))
    assert {n for n, ok in got if ok} == fine


def test_blank_and_trim(spark):
    rows = [(None,), ("",), (" \t\r\n\x1c\x1f",), (" 　",), (" ",), ("\x01",), (" a\x01b \x00\t",)]
    got = values(spark, rows, "v string", text.not_blank(F.col("v")), text.java_trim(F.col("v")))
    assert [seen for seen, _ in got] == [False, False, False, False, True, True, True]
    assert got[-1][1] == "a\x01b" and got[5][1] == ""


def test_paths(spark):
    rows = [("/warehouse/x.db/users/dt=1/p",), ("/warehouse/archive/dt=1/h=2/p",), ("hdfs://nn:8020/warehouse/a.db/warehouse/t/p",), ("a/b",)]
    p = F.col("p")
    got = values(
        spark, rows, "p string",
        paths.db_name(p), paths.table_name(p), paths.prefix_key(p), paths.relative_path(p, ["/warehouse"]), paths.path_component(p, 3), paths.file_name(p),
    )
    assert got[0] == ("x", "users", "warehouse/x.db", "x.db/users/dt=1/p", "users", "p")
    assert got[1] == (None, None, "warehouse/archive", "archive/dt=1/h=2/p", "dt=1", "p")
    assert got[2][:2] == ("a", "warehouse") and got[2][3] == "a.db/warehouse/t/p"  # only the leading root goes
    assert got[3][2] is None and got[3][3] == "a/b"


def test_target_and_absolute_path(spark):
    rows = [("/w/a.db/w/t", f) for f in ("orc", "parquet", "text", "text_gzip", "avro")]
    got = values(spark, rows, "p string, f string", paths.target_path(F.col("p"), F.col("f"), "/w"))
    assert [t for t, in got] == ["/w_repl/a.db/w/t"] * 2 + ["/w_text/a.db/w/t"] * 2 + [None]
    both = values(spark, [("a/b",), ("/w/a/b",), ("/w2/a",)], "p string", paths.absolute_path(F.col("p"), "/w"))
    assert [t for t, in both] == ["/w/a/b", "/w/a/b", "/w//w2/a"]
    assert values(spark, [("/w/b.db/t",)], "p string", paths.manifest_name(F.col("p"), ["/w"])) == [("b_db_t",)]
    some = paths.starts_with_any(F.col("p"), ["/x", "/w/b"])
    assert values(spark, [("/w/b.db/t",), ("/y",)], "p string", some) == [(True,), (False,)]


LINE = "logs/hadoop-hdfs-datanode-dn3.example.com.log:2024-01-01 00:00:07,123 "


def test_event_fields(spark):
    lines = [
        LINE + "WARN InvalidDecodingException: Failed to reconstruct BP-1:blk_-90_77",
        LINE + "INFO EC reconstruct striped blockId: -91",
        LINE + "INFO EC reconstruct striped blockId:blk_-92",
        LINE + "WARN Failed to reconstruct BP-1:blk_-93_5 then blk_-94_5",
        LINE + "INFO heartbeat",
        LINE.replace("-datanode-", "-dn-") + "Failed to reconstruct blk_-95_1",
        LINE.replace("dn3", "x-datanode-y") + "Failed to reconstruct blk_-96_1",
        "dn3.example.com.log:2024-01 Failed to reconstruct blk_-97_1",
        LINE + "Failed to reconstruct blk_none",
    ]
    v = F.col("v")
    got = values(spark, [(x,) for x in lines], "v string", logs.event_type(v), logs.block_id(v, logs.event_type(v)), logs.event_host(v), logs.event_time(v).cast("string"))
    at, host = "2024-01-01 00:00:07", "dn3.example.com"
    assert got == [
        ("invalidDecoding", -90, host, at),
        ("reconstruct", -91, host, at),
        ("reconstruct", -92, host, at),
        ("failed", -93, host, at),
        (None, None, host, at),
        ("failed", -95, None, at),
        ("failed", -96, None, at),
        ("failed", -97, None, None),
        ("failed", None, host, at),
    ]


def test_noise(spark):
    rows = [("Binary file x.log matches",), ("  ",), ("a line",)]
    assert [k for k, in values(spark, rows, "v string", logs.is_signal(F.col("v")))] == [False, False, True]


def test_short_host(spark):
    rows = [("  fs-dn-7.example.com/rack1 is HEALTHY",), ("other.example.com",), ("10.0.0.1:9866/rack",)]
    got = values(spark, rows, "h string", logs.short_host(F.col("h"), ["fs-dn-"], [".example.com"]))
    assert [h for h, in got] == ["7", "other", "10.0.0.1:9866/rack"]


def test_messages(spark):
    made = messages.mismatch_message(F.col("h"), F.col("b"))
    got = values(spark, [("10.0.0.1", -9), (None, -9)], "h string, b bigint", made, messages.suspect_host(made), messages.reported_path(messages.report_line(F.lit("a/b"), made)))
    assert got[0] == ("Status: ERROR, message: EC compute result not match.:ip is 10.0.0.1 block is : -9", "10.0.0.1", "a/b")
    assert got[1][1] is None
    assert re.search(r"ip is +block is", got[1][0])
    assert values(spark, [("nothing",)], "m string", messages.suspect_host(F.col("m"))) == [(None,)]
