from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import shards
from lakecheck.plans.mining import damaged_files
from lakecheck.session import fits_broadcast, scratch_path
from lakecheck.sources import lists, logs, reports, sinks
from lakecheck.streaming.logs import append_events, stream_events

HEAD = "x-datanode-dn{}.a.com.log:2024-01-{:02d} 00:00:07,1 "


def log_frame(spark, rows):
    lines = [(HEAD.format(host, day) + f"Failed to reconstruct blk_{block}_1",) for host, day, block in rows]
    return spark.createDataFrame([*lines, (HEAD.format(1, 1) + "heartbeat",), ("Binary file q matches",), ("",)], "value string")


def test_manifest_keeps_its_first_line(spark, tmp_path):
    (tmp_path / "m").write_text("a/b\n\n  c/d \t\n \x01 \n")
    got = [r["path"] for r in lists.read_manifest(spark, str(tmp_path / "m")).collect()]
    assert got == ["a/b", "c/d", ""]


def test_block_ids(spark, tmp_path):
    (tmp_path / "b").write_text("blk_-12\n-13\nblk_\n\nword\n")
    assert [r["block_id"] for r in lists.read_block_ids(spark, str(tmp_path / "b")).collect()] == [-12, -13]


def test_events_replace_only_their_days(spark, tmp_path):
    out = str(tmp_path / "events")
    sinks.write_events(logs.parse_events(log_frame(spark, [(1, 1, -5), (2, 2, -6)])), out)
    sinks.write_events(logs.parse_events(log_frame(spark, [(3, 2, -7)])), out)
    back = lists.read_events(spark, out)
    rows = {(str(r["dt"]), r["host"], r["block_id"], str(r["event_time"])) for r in back.collect()}
    assert rows == {("2024-01-01", "dn1.a.com", -5, "2024-01-01 00:00:07"), ("2024-01-02", "dn3.a.com", -7, "2024-01-02 00:00:07")}
    recent = sinks.keep_recent(back, "2024-01-04")
    assert {str(r["dt"]) for r in recent.collect()} == {"2024-01-02"}


def test_rejects_have_a_reason(spark):
    lines = log_frame(spark, []).unionByName(
        spark.createDataFrame([("a:2024-01-01 00:00:07 Failed to reconstruct blk_x",), ("Failed to reconstruct blk_-1_2",), ("a:202",)], "value string")
    )
    assert sorted(r["reason"] for r in logs.rejected_lines(lines).collect()) == ["no block", "no event type", "no event type", "no time"]


def test_report_is_not_redone(spark, tmp_path):
    rows = [("p", -1, "bad"), ("q", 0, None), ("r", 1, "?")]
    results = spark.createDataFrame(rows, "path string, status int, msg string")
    out = str(tmp_path / "report")
    sinks.write_check_report(results, out)
    assert [r["value"] for r in lists.read_error_report(spark, out + "/damaged").collect()] == ["p===bad"]
    assert tuple(spark.read.parquet(out + "/summary").first()) == (2, 1, 1)
    unread = results.withColumn("status", F.raise_error(F.lit("checked again")).cast("int"))
    assert not sinks.write_check_report(unread, out)  # refused before any check runs
    shutil.rmtree(out + "/summary")  # as after a crash between the two outputs
    assert sinks.write_check_report(results.limit(0), out) and spark.read.text(out + "/damaged").isEmpty()
    assert sinks.write_check_report(results, out, redo=True) and spark.read.text(out + "/damaged").count() == 1


def test_rewriting_leaves_nothing_old(spark, conf, tmp_path):
    conf("spark.sql.sources.partitionOverwriteMode", "dynamic")
    out = str(tmp_path / "shards")
    for n in (10, 3):
        sinks.write_shards(spark.range(n).selectExpr("cast(id as int) as shard", "'x' as value"), out)
    assert spark.read.text(out).select("shard").distinct().count() == 3


def test_equal_rows_spread_over_shards(spark, monkeypatch):
    sizes, write = [], shards.materialize

    def counted(df, label):
        sizes.extend(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        return write(df, label)

    monkeypatch.setattr(shards, "materialize", counted)
    equal = spark.range(40_000).selectExpr("1 as a")
    placed = shards.with_row_index(equal, "a", partitions=4)
    assert [r["idx"] for r in placed.orderBy("idx").limit(3).collect()] == [0, 1, 2]
    assert len(sizes) == 4 and max(sizes) < 20_000 and sum(sizes) == 40_000


def test_block_status_only_if_any(spark, tmp_path):
    rows = [(-1, None, ["a", "b"], None), (-2, "/p", [], -1)]
    status = spark.createDataFrame(rows, "block_id bigint, path string, hosts array<string>, status int").withColumn(
        "checked_at", F.lit("2024-01-01 10:00:00").cast("timestamp")
    )
    assert not sinks.write_block_status(status.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.write_block_status(status, str(tmp_path / "some"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "some")).collect())
    assert lines == ["-1,fpNull,a_b,,2024-01-01 10:00:00", '-2,/p,"",-1,2024-01-01 10:00:00']


def test_block_report(spark):
    rows = [
        (-1, "Block Id: blk_-1"), (-1, "Block belongs to: /w/a "), (-1, "No. of Expected Replica: 3"),
        (-1, "Block replica on datanode/rack: dn2.example.com/r1 is HEALTHY"), (-1, "Block replica on datanode/rack: dn1.example.com/r1 is HEALTHY"),
        (-2, "Block replica on datanode/rack: dn1.example.com/r1 is CORRUPT"), (-3, "Block does not exist"),
    ]
    got = reports.parse_block_report(spark.createDataFrame(rows, "block_id bigint, value string"), (), (".example.com",))
    assert {(r["block_id"], r["path"], tuple(r["hosts"])) for r in got.collect()} == {(-1, "/w/a", ("dn1", "dn2")), (-2, None, ("dn1",))}


def test_flagship_on_a_small_case(spark):
    lines = log_frame(spark, [(1, 1, -1), (2, 1, -1), (1, 1, -2), (1, 1, -3), (1, 1, -4)])
    block_map = spark.createDataFrame(
        [(-1, "/w/a.db/t/f", ["x"]), (-2, "/w/a.db/t/f", ["y"]), (-3, "/w/skip.db/t/g", ["z"])], "block_id bigint, path string, hosts array<string>"
    )
    skipped = spark.createDataFrame([("w/skip.db",)], "prefix string")
    results = spark.createDataFrame([("/w/a.db/t/f", -1)], "path string, status int")
    got = damaged_files(lines, block_map, skipped, results).collect()
    assert {(r["block_id"], r["path"], r["status"]) for r in got} == {(-1, "/w/a.db/t/f", -1), (-2, "/w/a.db/t/f", -1), (-4, None, None)}


def test_stream_takes_each_file_once(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("logs", "out", "marks"))
    log_frame(spark, [(1, 1, -5), (2, 2, -6)]).coalesce(1).write.text(source)
    append_events(stream_events(spark, source, 1), out, marks).awaitTermination()
    log_frame(spark, [(3, 3, -7)]).coalesce(1).write.mode("append").text(source)
    append_events(stream_events(spark, source, 1), out, marks).awaitTermination()
    assert sorted(r["block_id"] for r in spark.read.parquet(out).collect()) == [-7, -6, -5]


def test_scratch_is_below_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_broadcast_is_measured(spark):
    df = spark.range(1000).withColumn("v", F.lit("x" * 100))
    assert fits_broadcast(df) and fits_broadcast(df.limit(0))
    assert not fits_broadcast(df, max_rows=999) and not fits_broadcast(df, max_bytes=1000)


def test_a_dead_run_leaves_the_old_version(spark, tmp_path):
    out = str(tmp_path / "out")
    old, new = (spark.createDataFrame([(x, "d", "t", x)], "path string, db string, table string, value string") for x in ("old", "new"))

    def dies(df, version):
        sinks.write_manifests(df, version)
        raise RuntimeError

    assert sinks.published(spark, out) is None
    with pytest.raises(RuntimeError):
        sinks.publish(new, out, dies)
    assert sinks.published(spark, out) is None
    for df, name in ((old, "old"), (new, "new"), (old, "old")):
        assert sinks.publish(df, out, sinks.write_manifests) == sinks.published(spark, out)
        assert [r["value"] for r in spark.read.text(sinks.published(spark, out)).collect()] == [name]
        with pytest.raises(RuntimeError):
            sinks.publish(new, out, dies)
        assert [r["value"] for r in spark.read.text(sinks.published(spark, out)).collect()] == [name]
