"""Fact tables rendered from the driver's tables, always from all of their rows.

Damage is put in by key (``% 37`` and the like), so that the oracles can say from the
source columns alone which rows must be found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.functions.messages import UNDER_CODED, mismatch_message
from lakecheck.operators.parity import Policy, encode_rows
from lakecheck.session import materialize

ROOT = "/warehouse"
FIRST_BLOCK = 9_000_000
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
RS = Policy(6, 3, cell_size=16)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PATH = "concat('/warehouse/db', o_custkey % 5, '.db/t', o_orderkey % 9, '/part-', o_orderkey)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = f"({FIRST_BLOCK} + (event_id div 3) * 5)"
    file = "concat('hadoop-hdfs-datanode-dn', user_id % 12, '.example.com.log')"
    text = f"""case event_type
        when 'error' then concat('WARN InvalidDecodingException: Failed to reconstruct striped block BP-1:blk_-', {block}, '_', event_id)
        when 'purchase' then concat('INFO EC reconstruct striped blockId: -', {block})
        when 'signup' then concat('WARN Failed to reconstruct striped block BP-1:blk_-', {block}, '_77')
        else 'INFO heartbeat' end"""
    line = f"""case when event_type = 'view' then concat('Binary file ', {file}, ' matches')
        else concat({file}, ':', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ',000 ', {text}) end"""
    return table(spark, sf_dir, "events").select(F.expr(line).alias("value"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per order: ``key, path, length, modification_time``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("key"),
        F.expr(PATH).alias("path"),
        F.expr("cast(round(o_totalprice * 100) as bigint)").alias("length"),
        F.col("o_orderdate").alias("modification_time"),
    )


def block_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (-(F.col("o_orderkey") + FIRST_BLOCK)).alias("block_id"),
        F.expr(PATH).alias("path"),
        F.expr("array(concat('dn', o_custkey % 12), concat('dn', (o_custkey + 5) % 12))").alias("hosts"),
    )


def exclusions(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('warehouse/db1.db'), ('warehouse/none.db') AS t(prefix)")


def registry(spark: SparkSession) -> DataFrame:
    return spark.sql(r"""SELECT * FROM VALUES ('t0', 'text', 5, '\t'), ('t1', 'text_gzip', 5, '\t'), ('t2', 'parquet', NULL, NULL),
        ('t3', 'text', 11, '\t'), ('t4', 'text_gzip', 11, '\t') AS t(table, format, n_cols, sep)""")


def line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct order line: ``g, line, a, b`` (two 64-bit words of content)."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("line")
    ).agg(
        F.bit_xor(F.expr("cast(round(l_extendedprice * 100) as bigint)")).alias("a"),
        F.bit_xor(F.expr("l_partkey * 1000003 + l_suppkey")).alias("b"),
    )


def xor_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an xor-coded group per order; its parity is off by one bit if ``g % 37 = 0``."""
    units = line_units(spark, sf_dir)
    flip = F.expr("if(g % 37 = 0, 1L, 0L)")
    parity = units.groupBy("g").agg(F.bit_xor("a").alias("p")).select(
        F.col("g").alias("group_id"), F.lit(7).alias("unit_index"), F.col("p").bitwiseXOR(flip).alias("word")
    )
    data = units.select(F.col("g").alias("group_id"), (F.col("line") - 1).alias("unit_index"), F.col("a").alias("word"))
    return data.unionByName(parity).withColumns({"stripe_no": F.lit(0), "word_no": F.lit(0)})


def data_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data cells of 16 bytes; lines 1-6 are stripe 0, line 7 begins stripe 1."""
    word = "lpad(hex({0}), 16, '0')"
    return line_units(spark, sf_dir).select(
        F.col("g").alias("group_id"),
        F.expr("cast((line - 1) div 6 as int)").alias("stripe_no"),
        F.expr("cast((line - 1) % 6 as int)").alias("unit_index"),
        F.expr(f"unhex(concat({word.format('a')}, {word.format('b')}))").alias("payload"),
    )


def data_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of :func:`data_cells` by one aggregate, a row for each stripe: ``payloads`` of six units."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS group_id", "cast((l_linenumber - 1) div 6 as int) AS stripe_no", "cast((l_linenumber - 1) % 6 as int) AS unit",
        "cast(round(l_extendedprice * 100) as bigint) AS a", "l_partkey * 1000003 + l_suppkey AS b")
    words = [F.bit_xor(F.when(F.col("unit") == u, F.col(w))).alias(f"{w}{u}") for u in range(RS.k) for w in "ab"]
    held = F.bit_or(F.expr("shiftleft(1, unit)")).alias("held")
    word = "lpad(hex({0}), 16, '0')"
    payload = [F.expr(f"if(held & {1 << u} != 0, unhex(concat({word.format(f'a{u}')}, {word.format(f'b{u}')})), null)") for u in range(RS.k)]
    return lines.groupBy("group_id", "stripe_no").agg(held, *words).select("group_id", "stripe_no", F.array(*payload).alias("payloads"))


def _flip(byte: int) -> Column:
    """Payload with all bits of one byte inverted; computed for the rows that ask for it."""
    code = "lpad(hex(255 - cast(conv(substr(hex(payload), {0}, 2), 16, 10) as int)), 2, '0')".format(byte * 2 + 1)
    return F.expr(f"unhex(concat(substr(hex(payload), 1, {byte * 2}), {code}, substr(hex(payload), {byte * 2 + 3})))")


def rs_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RS(6,3) cells, rendered once and written. Damage: first parity unit if ``g % 41 = 0``, and
    the first data unit of stripe 0 if ``g % 43 = 0`` and it is there."""
    cells = encode_rows(data_stripes(spark, sf_dir), RS)
    bad_parity = F.expr("group_id % 41 = 0 and unit_index = 6")
    bad_data = F.expr("group_id % 43 = 0 and unit_index = 0 and stripe_no = 0")
    payload = F.when(bad_parity, _flip(0)).when(bad_data, _flip(9)).otherwise(F.col("payload"))
    return materialize(cells.select("group_id", "stripe_no", "unit_index", payload.alias("payload")), "cells")


def long_groups(cells: DataFrame) -> DataFrame:
    """The stripes of 250 orders as those of one group: two stripes for each order."""
    return cells.selectExpr("group_id div 250 as group_id", "cast(group_id % 250 * 2 + stripe_no as int) as stripe_no", "unit_index", "payload")


def whole_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undamaged RS(6,3) cells of :func:`long_groups`, written."""
    return materialize(long_groups(encode_rows(data_stripes(spark, sf_dir), RS)), "cells")


def one_bit(payload: Column) -> Column:
    """Payload with the last bit of its first byte inverted."""
    h = F.hex(payload)
    byte = F.conv(F.substring(h, 1, 2), 16, 10).cast("int").bitwiseXOR(1)
    return F.unhex(F.concat(F.lpad(F.hex(byte), 2, "0"), F.substring(h, 3, 1 << 30)))


def beyond_repair(cells: DataFrame) -> DataFrame:
    """Flip a bit in all parity units of every 47th group, in a different byte of each."""
    at = F.expr("unit_index - 5")
    hexed = F.hex("payload")
    byte = F.conv(F.substring(hexed, at * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(1)
    changed = F.concat(F.substring(hexed, F.lit(1), at * 2), F.lpad(F.hex(byte), 2, "0"), F.substring(hexed, at * 2 + 3, F.lit(64)))
    hit = F.expr("group_id % 47 = 0 and unit_index > 5 and stripe_no = 0")
    return cells.withColumn("payload", F.when(hit, F.unhex(changed)).otherwise(F.col("payload")))


def rs_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine units of the group of every order that has lines; its size is that of the
    cells up to the last line. Groups are joined once and written, units made of them as asked."""
    groups = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.max("l_linenumber").alias("last"))
    files = materialize(order_files(spark, sf_dir).join(groups, "key").select("key", "path", "last"), "groups-held")
    return files.select(
        F.col("key").alias("group_id"),
        "path",
        (F.col("last") * 16).cast("bigint").alias("group_size"),
        F.explode(F.sequence(F.lit(0), F.lit(8))).alias("unit_index"),
    ).withColumn("host", F.expr("concat('10.0.', unit_index, '.', group_id % 200)"))


def supplier_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of an order's group on the hosts of its suppliers."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.expr("concat('h', l_suppkey)").alias("host"), "l_linenumber", "l_quantity"
    )
    return order_files(spark, sf_dir).join(lines, "key").select(
        F.col("key").alias("group_id"), "path", "host", (F.col("l_linenumber") - 1).alias("unit_index"), "l_quantity"
    )


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, status, msg`` per order: damaged (with or without a host), fine, unchecked."""
    orders = table(spark, sf_dir, "orders").withColumn("path", F.expr(PATH))
    host, block = F.expr("concat('10.0.0.', o_custkey % 250)"), -(F.col("o_orderkey") + FIRST_BLOCK)
    msg = (
        F.when(F.col("o_orderstatus") == "F", mismatch_message(host, block))
        .when(F.col("o_orderpriority") == "1-URGENT", F.lit(f"Status: ERROR, message: {UNDER_CODED}"))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("File "), F.col("path"), F.lit(" is not closed.")))
    )
    status = F.expr(
        "case when o_orderstatus = 'F' or o_orderpriority = '1-URGENT' then -1 when o_orderstatus = 'P' then 1 else 0 end"
    )
    return orders.select("path", status.alias("status"), msg.alias("msg"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-report lines: the owner from ``orders``, a replica line per order line."""
    owner = table(spark, sf_dir, "orders").select(
        (-(F.col("o_orderkey") + FIRST_BLOCK)).alias("block_id"),
        F.expr(f"concat('Block belongs to: ', {PATH}, ' ')").alias("value"),
    )
    replica = table(spark, sf_dir, "lineitem").select(
        (-(F.col("l_orderkey") + FIRST_BLOCK)).alias("block_id"),
        F.expr(
            "concat('Block replica on datanode/rack: fs-dn-', l_suppkey, '.example.com/rack', l_linenumber, ' is HEALTHY')"
        ).alias("value"),
    )
    return owner.unionByName(replica)


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab lines of 5 columns in 8 parts ``p``: short (``% 11``: still fine, ``% 13``: bad) or
    with a field too many (``% 17``)."""
    fields = "c_custkey, c_name, c_nationkey"
    line = f"""case when c_custkey % 13 = 0 then concat_ws('\\t', c_custkey, c_name)
        when c_custkey % 17 = 0 then concat_ws('\\t', {fields}, 'a', 'b', 'c')
        when c_custkey % 11 = 0 then concat_ws('\\t', {fields}, '', '')
        else concat_ws('\\t', {fields}, c_mktsegment, 'z') end"""
    return table(spark, sf_dir, "customer").select(
        F.expr("cast(c_custkey % 8 as int)").alias("p"), F.col("c_custkey").alias("key"), F.expr(line).alias("value")
    )


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab lines of 5 columns of all customers, in 8 parts ``p``."""
    line = "concat_ws('\t', c_custkey, c_name, c_nationkey, c_mktsegment, 'z')"
    return table(spark, sf_dir, "customer").select(F.expr("cast(c_custkey % 8 as int)").alias("p"), F.expr(line).alias("value"))


def lineitem_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab lines of 11 columns in 8 parts ``p``, with 4 fields (``l_partkey % 23``, bad), 5
    (``% 19``, fine) or 13 (``% 29``, fine)."""
    five = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag"
    line = f"""case when l_partkey % 23 = 0 then concat_ws('\\t', l_orderkey, l_partkey, l_suppkey, 'x', '', '')
        when l_partkey % 19 = 0 then concat_ws('\\t', {five})
        when l_partkey % 29 = 0 then concat_ws('\\t', {five}, 1, 2, 3, 4, 5, 6, 7, 8)
        else concat_ws('\\t', {five}, 1, 2, 3, 4, 5, 6) end"""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("cast(l_orderkey % 8 as int)").alias("p"), F.col("l_orderkey").alias("key"), F.expr(line).alias("value")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\r\n|\r|\n")).alias("value"))
