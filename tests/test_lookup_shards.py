from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import aggregates, lookup, shards
from lakecheck.operators.compaction import line_fingerprint
from lakecheck.sources import files


def paths_of(df):
    return sorted(r["path"] for r in df.collect())


@pytest.fixture
def inventory(spark):
    rows = [(f"/warehouse/{db}.db/{t}/p{i}", 10 + i) for db in ("a", "b") for t in ("t0", "t1") for i in range(3)]
    return files.with_table(spark.createDataFrame(rows, "path string, length bigint"))


@pytest.fixture(params=[True, False], ids=["broadcast", "salted"])
def either_join(request, monkeypatch):
    monkeypatch.setattr(lookup, "fits_broadcast", lambda df: request.param)


def test_registry_default_format(spark, inventory, either_join):
    registry = spark.createDataFrame([("t0", "text", 13, "\x01")], "`table` string, format string, n_cols int, sep string")
    got = Counter((r["table"], r["format"], r["n_cols"]) for r in lookup.route_format(inventory, registry).collect())
    assert got == {("t0", "text", 13): 6, ("t1", "orc", None): 6}


def test_exclusions(spark, inventory, either_join):
    dbs = spark.createDataFrame([("a",), ("a",)], "db string")
    assert {p.split("/")[2] for p in paths_of(lookup.exclude_databases(inventory, dbs))} == {"b.db"}
    listed = spark.createDataFrame([("warehouse/archive",), ("warehouse/b.db",)], "prefix string")
    more = spark.createDataFrame([("/warehouse/archive/dt=1/h=2/p", 1, None, None), (None, 1, None, None)], inventory.schema)
    kept = [r["path"] for r in lookup.exclude_prefixes(inventory.unionByName(more), listed).collect()]
    assert len(kept) == 7 and None in kept and not any(p and "/b.db" in p or p and "archive" in p for p in kept)


def test_salted_join_keeps_every_row(spark, either_join):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("table"), "id")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "`table` string, v int")
    joined = lookup.dimension_join(left, right, "table", "left")
    assert joined.count() == 3000 and joined.where("v = 1").count() == 1000 and joined.where("v = 2").count() == 1
    assert lookup.dimension_join(left, right, "table", "left_semi").count() == 1001
    assert lookup.dimension_join(left, right, "table", "left_anti").count() == 1999


def test_prefix_routing_tests_every_prefix(inventory):
    routed = lookup.route_by_prefix(inventory, ["/nowhere", "/warehouse/a.db/t1"])
    assert Counter(r["format"] for r in routed.collect()) == {"parquet": 3, "orc": 9}


def test_pending(spark, inventory):
    done = inventory.where("db = 'a'").select("path")
    assert len(paths_of(lookup.pending(inventory.select("path"), done))) == 6


def test_tables_and_sizes(inventory):
    assert files.list_tables(inventory).count() == 4
    total = aggregates.dir_size(inventory).first()
    assert (total["n_bytes"], total["n_files"]) == (132, 12)
    assert aggregates.dir_size(inventory.limit(0)).first()["n_bytes"] == 0


def sizes(df):
    return [n for _, n in sorted(Counter(r["shard"] for r in df.collect()).items())]


@pytest.mark.parametrize("n, k, expected", [(11, 3, [3, 3, 3, 2]), (12, 3, [4, 4, 4]), (2, 7, [2]), (0, 3, [])])
def test_shard_even(spark, n, k, expected):
    df = spark.range(n).repartition(3)
    cut = shards.shard_even(df, "id", k=k)
    assert sizes(cut) == expected
    assert [r["id"] for r in cut.orderBy("idx").collect()] == list(range(n))
    if n < k:
        assert all(r["shard"] == k for r in cut.collect())


@pytest.mark.parametrize("n, size, expected", [(12, 3, [3, 3, 3, 3]), (13, 3, [3, 3, 3, 3, 1]), (2, 2000, [2])])
def test_shard_fixed(spark, n, size, expected):
    cut = shards.shard_fixed(spark.range(n), "id", size=size)
    assert sizes(cut) == expected and min(r["shard"] for r in cut.collect()) == 1


def test_row_index_with_a_hot_key(spark):
    """A third of the rows share a key: positions stay a permutation in key order, and the
    rows of the key lie in several partitions."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    indexed = shards.with_row_index(df, "k", partitions=8)
    rows = sorted((r["idx"], r["k"]) for r in indexed.collect())
    assert [i for i, _ in rows] == list(range(9000))
    assert [k for _, k in rows] == sorted(k for _, k in rows)
    keys = [F.col("k"), F.xxhash64("k", "id")]
    spread = df.repartitionByRange(8, *keys).where("k = 5").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 2


def test_cap_is_deterministic(spark):
    events = spark.range(100).select((-F.col("id") % 30).alias("block_id"))


def test_word_count_tokens(spark):
    df = spark.createDataFrame([(" a b\ta\f\r\nb c ",), ("",), (None,)], "value string")
    assert {r["word"]: r["n"] for r in aggregates.word_count(df).collect()} == {"a": 2, "b": 2, "c": 1}


def test_alert(spark):
    rows = [(1, "p", 0), (2, "p", -1), (3, None, None), (4, "q", 1)]
    got = aggregates.alert(spark.createDataFrame(rows, "block_id int, path string, status int")).first()
    assert (got["n_alerts"], got["raise"]) == (2, True)


def test_prefixes_as_a_table(spark, conf):
    paths = ["/w/a.db/t/f1", "/w/a.db/t/f12", "/w/a.db/u/f", "/w", "", "/x"]
    files = spark.createDataFrame([(p, 1) for p in [*paths, "/x"]], "path string, size int")
    prefixes = spark.createDataFrame([("/w/a", "text"), ("/w/a.db/t/f1", "parquet"), ("/w/a.db/t/f12", "text_gzip"), (None, "none")], "prefix string, format string")
    want = {"/w/a.db/t/f1": "parquet", "/w/a.db/t/f12": "text_gzip", "/w/a.db/u/f": "text", "/w": "orc", "": "orc", "/x": "orc"}
    got = lookup.route_by_prefixes(files, prefixes)
    assert {r["path"]: r["format"] for r in got.collect()} == want and got.count() == 7 and got.columns == ["path", "size", "format"]
    assert {r["format"] for r in lookup.route_by_prefixes(files, prefixes.limit(0)).collect()} == {"orc"}
    many = spark.range(120_000).selectExpr("concat('/w/p', id) AS prefix", "'parquet' AS format")
    routed = lookup.route_by_prefixes(spark.createDataFrame([("/w/p77777/f",), ("/v/p1",)], "path string"), many)
    assert {r["path"]: r["format"] for r in routed.collect()} == {"/w/p77777/f": "parquet", "/v/p1": "orc"}


def test_fingerprints_of_lines(spark):
    lines = spark.createDataFrame([("a",), ("b",), ("b",), ("",)], "value string")

    def of(rows):
        return tuple(line_fingerprint(spark.createDataFrame([(r,) for r in rows], "value string")).first())

    assert of(["b", "", "a", "b"]) == tuple(line_fingerprint(lines).first())
    assert len({of(x) for x in (["a", "b"], ["a", "a"], ["b", "b"], ["ab"], ["a", "b", ""], [])}) == 6
