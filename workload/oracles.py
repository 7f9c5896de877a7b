"""The expected answers in SQL, computed from the source columns of the tables."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
EV = """ev AS (SELECT CASE event_type WHEN 'error' THEN 'invalidDecoding' WHEN 'purchase' THEN 'reconstruct'
      ELSE 'failed' END AS event_type, 'dn' || (user_id % 12) || '.example.com' AS host,
    -(9000000 + (event_id // 3) * 5) AS block_id, date_trunc('second', ts) AS event_time
  FROM events WHERE event_type IN ('error', 'purchase', 'signup'))"""
PATH = "'/warehouse/db' || (o_custkey % 5) || '.db/t' || (o_orderkey % 9) || '/part-' || o_orderkey"
FILES = f"""f AS (SELECT o_orderkey AS key, {PATH} AS path, 'db' || (o_custkey % 5) AS db, 't' || (o_orderkey % 9) AS tab,
    CAST(round(o_totalprice * 100) AS BIGINT) AS length, o_custkey, o_orderstatus, o_orderpriority FROM orders)"""
BLOCKS = f"""{EV}, {FILES}, b AS (SELECT DISTINCT block_id FROM ev),
  m AS (SELECT -(9000000 + key) AS block_id, path, db, key,
    'dn' || (o_custkey % 12) || '_' || 'dn' || ((o_custkey + 5) % 12) AS hosts FROM f)"""
FLAGSHIP = f"""{BLOCKS}, lines AS (SELECT DISTINCT l_orderkey FROM lineitem),
  flag AS (SELECT b.block_id, m.path, m.hosts, CASE WHEN lines.l_orderkey IS NULL THEN NULL
      WHEN m.key % 37 = 0 THEN '-1' ELSE '0' END AS status
    FROM b LEFT JOIN m USING (block_id) LEFT JOIN lines ON lines.l_orderkey = m.key
    WHERE m.db IS DISTINCT FROM 'db1')"""
UNITS = """u AS (SELECT l_orderkey AS g, l_linenumber AS line,
    bit_xor(CAST(round(l_extendedprice * 100) AS BIGINT)) AS a, bit_xor(l_partkey * 1000003 + l_suppkey) AS b
  FROM lineitem GROUP BY ALL)"""
# byte positions 0-15 of the cells, and the products of GF(2^8) by logarithms
BYTES = f"""{UNITS}, pos AS (SELECT range AS i FROM range(16)),
  bytes AS (SELECT g AS group_id, CAST((line - 1) // 6 AS INTEGER) AS stripe_no, CAST((line - 1) % 6 AS INTEGER) AS unit, i,
    CAST(((CASE WHEN i < 8 THEN a ELSE b END) >> CAST(8 * (7 - i % 8) AS INTEGER)) & 255 AS INTEGER) AS v FROM u, pos)"""
GF = """power AS (SELECT 0 AS e, 1 AS x UNION ALL
    SELECT e + 1, CASE WHEN x >= 128 THEN xor(x * 2, 285) ELSE x * 2 END FROM power WHERE e < 254),
  coef AS (SELECT r.range AS i_row, c.range AS unit, (255 - p.e) % 255 AS e
    FROM range(3) r, range(6) c JOIN power p ON p.x = xor(6 + r.range, c.range))"""
CUSTOMER = """c AS (SELECT c_custkey AS key, CAST(c_custkey % 8 AS VARCHAR) AS part,
    CASE WHEN c_custkey % 13 = 0 THEN concat_ws(chr(9), c_custkey, c_name)
      WHEN c_custkey % 17 = 0 THEN concat_ws(chr(9), c_custkey, c_name, c_nationkey, 'a', 'b', 'c') END AS bad_value,
    row_number() OVER (PARTITION BY c_custkey % 8 ORDER BY c_custkey) AS line FROM customer)"""
LINES = """v AS (SELECT l_orderkey AS key, CAST(l_orderkey % 8 AS VARCHAR) AS part,
    concat_ws(chr(9), l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag) AS five,
    concat_ws(chr(9), l_orderkey, l_partkey, l_suppkey, 'x', '', '') AS four, l_partkey FROM lineitem),
  w AS (SELECT key, part, CASE WHEN l_partkey % 23 = 0 THEN four WHEN l_partkey % 19 = 0 THEN five
      WHEN l_partkey % 29 = 0 THEN concat_ws(chr(9), five, 1, 2, 3, 4, 5, 6, 7, 8)
      ELSE concat_ws(chr(9), five, 1, 2, 3, 4, 5, 6) END AS value, l_partkey % 23 = 0 AS bad FROM v),
  c AS (SELECT part, CASE WHEN bad THEN value END AS bad_value,
    row_number() OVER (PARTITION BY part ORDER BY key, value) AS line FROM w)"""
TEXT_VERDICT = """SELECT part, CASE WHEN count(bad_value) > 0 THEN -1 ELSE 0 END AS status, count(*) AS n_rows,
  count(bad_value) AS n_bad, CAST(min(line) FILTER (bad_value IS NOT NULL) AS VARCHAR) AS first_bad_line,
  arg_min(bad_value, line) FILTER (bad_value IS NOT NULL) AS first_bad FROM c GROUP BY part"""
HOSTS = """h AS (SELECT DISTINCT l_orderkey AS g, 'h' || l_suppkey AS host FROM lineitem),
  r AS (SELECT g, host, row_number() OVER (PARTITION BY g ORDER BY host) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
  p AS (SELECT a.g, CAST(a.i * (2 * a.n - a.i - 1) // 2 + b.i - a.i - 1 AS INTEGER) AS pair_no, a.host || ',' || b.host AS pair
    FROM r a JOIN r b ON a.g = b.g AND a.i < b.i)"""
# damaged files by key, with the host their message names
DAMAGED = f"""{FILES}, dmg AS (SELECT key, path, CASE WHEN o_orderstatus = 'F' THEN '10.0.0.' || (o_custkey % 250) END AS host
  FROM f WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')"""
ATTEMPTS = f"""{HOSTS}, {DAMAGED}, att AS (
    SELECT g, path, 1 AS attempt_no, host AS excluded FROM dmg JOIN (SELECT DISTINCT g FROM r) x ON x.g = dmg.key WHERE host IS NOT NULL
    UNION ALL SELECT g, path, pair_no + 2, pair FROM dmg JOIN p ON p.g = dmg.key)"""
RESULTS = f"""{FILES}, res AS (SELECT path, CASE WHEN o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' THEN -1
      WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS status,
    CASE WHEN o_orderstatus = 'F' THEN 'Status: ERROR, message: EC compute result not match.:ip is 10.0.0.' || (o_custkey % 250)
        || ' block is : ' || -(9000000 + key)
      WHEN o_orderpriority = '1-URGENT' THEN 'Status: ERROR, message: Block group is under-erasure-coded.'
      WHEN o_orderstatus = 'P' THEN 'File ' || path || ' is not closed.' END AS msg FROM f)"""
# stripes and damage of the RS(6,3) cells: first parity unit (g % 41), first data unit (g % 43)
STRIPES = """s AS (SELECT l_orderkey AS group_id, CAST((l_linenumber - 1) // 6 AS INTEGER) AS stripe_no,
    l_orderkey % 41 = 0 AS bad_p, l_orderkey % 43 = 0 AND bool_or(l_linenumber = 1) AS bad_d
  FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) // 6), bad_stripes AS (SELECT group_id, stripe_no, CASE WHEN bad_d THEN '0,1,2' WHEN bad_p THEN '0' ELSE '' END AS bad_parity FROM s)"""
GROUPS = f"""{STRIPES}, grp AS (SELECT group_id, bool_or(bad_p) AS bad_p, bool_or(bad_d) AS bad_d,
    min(stripe_no) FILTER (bad_parity <> '') AS first_bad FROM s JOIN bad_stripes USING (group_id, stripe_no) GROUP BY group_id)"""
# stripes that the size of a group asks for, and those that any line belongs to
SEEN = """seen AS (SELECT l_orderkey AS group_id, (max(l_linenumber) - 1) // 6 + 1 AS n_stripes, count(DISTINCT (l_linenumber - 1) // 6) AS n_seen
  FROM lineitem GROUP BY l_orderkey)"""
# stripes and data units of groups of 250 orders
LONG = """l AS (SELECT l_orderkey // 250 AS g, l_orderkey % 250 * 2 + (l_linenumber - 1) // 6 AS stripe, (l_linenumber - 1) % 6 AS unit FROM lineitem)"""
META = """CASE WHEN o_orderpriority = '5-LOW' THEN 'does not exist' WHEN o_orderstatus = 'P' THEN 'is not a regular file'
  WHEN o_custkey % 4 = 0 THEN 'is not closed' WHEN key % 6 = 0 THEN 'is not erasure coded' END"""
PARQUET = " UNION ALL ".join(
    f"SELECT '{t}' AS name, 0 AS status, count(*) AS n_rows FROM {t}"
    for t in TABLES
)
DAMAGED_PARTS = "SELECT DISTINCT CAST(o_custkey % 4 AS VARCHAR) AS part, CASE WHEN o_custkey % 4 IN (1, 2) THEN -1 ELSE 0 END AS status FROM orders"
# groups of which a file's repair must fail, and what the tried groups of a file give
TRIED = f"""{GROUPS}, hurt AS (SELECT group_id, bool_or(bad_p) AS bad_p, bool_or(bad_d) AS bad_d,
    group_id % 47 = 0 AND min(stripe_no) = 0 AS hopeless FROM s GROUP BY group_id),
  tried AS (SELECT group_id, '/w/f' || (group_id // 2) AS path, hopeless,
    CASE WHEN hopeless THEN 0 WHEN bad_d AND bad_p THEN 7 WHEN bad_d THEN 2 ELSE 1 END AS attempt_no
  FROM hurt WHERE bad_p OR bad_d OR hopeless),
  outc AS (SELECT path, CASE WHEN bool_or(hopeless) THEN 'failed' ELSE 'recovered' END AS outcome, count(*) AS n_groups,
    count(*) FILTER (NOT hopeless) AS n_recovered FROM tried GROUP BY path)"""

ORACLES = {
    # logs
    "parse_events": f"WITH {EV} SELECT event_type, host, block_id, event_time FROM ev",
    "rejected_lines": "SELECT 'no event type' AS reason, count(*) AS n FROM events WHERE event_type = 'click' HAVING count(*) > 0",
    "read_logs": f"WITH {EV} SELECT event_type, host, count(*) AS n FROM ev GROUP BY ALL",
    "stream_log_events": f"WITH {EV} SELECT event_type, strftime(event_time, '%Y-%m-%d') AS dt, count(*) AS n FROM ev GROUP BY ALL",
    "distinct_blocks": f"WITH {EV} SELECT DISTINCT block_id FROM ev",
    "sort_events": f"WITH {EV} SELECT event_type, block_id FROM ev ORDER BY ALL",
    "manifest_counts": f"WITH {EV} SELECT count(*) AS n_lines, count(DISTINCT block_id) AS n_distinct FROM ev",
    "write_events": f"WITH {EV} SELECT *, strftime(event_time, '%Y-%m-%d') AS dt FROM ev",
    "keep_recent": f"""WITH {EV} SELECT strftime(event_time, '%Y-%m-%d') AS dt, count(*) AS n FROM ev
        WHERE event_time >= DATE '2024-01-13' GROUP BY ALL""",
    # blocks and files
    "blocks_to_files": f"WITH {BLOCKS} SELECT block_id, path, hosts FROM b LEFT JOIN m USING (block_id)",
    "damaged_files": f"WITH {FLAGSHIP} SELECT * FROM flag",
    "alert": f"""WITH {FLAGSHIP} SELECT count(*) FILTER (status <> '0') AS n_alerts, count(*) FILTER (status <> '0') > 0 AS raise FROM flag""",
    "write_block_status": f"WITH {FLAGSHIP} SELECT block_id, coalesce(path, 'fpNull') AS path, hosts, status FROM flag",
    "write_block_map": f"WITH {BLOCKS} SELECT block_id, coalesce(path, 'fpNull') AS path FROM b LEFT JOIN m USING (block_id)",
    "block_report": f"""WITH {FILES}, h AS (SELECT l_orderkey AS key, string_agg(DISTINCT host, '_' ORDER BY host) AS hosts
          FROM (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS host FROM lineitem) GROUP BY l_orderkey)
        SELECT -(9000000 + key) AS block_id, path, coalesce(hosts, '') AS hosts FROM f FULL JOIN h USING (key)""",
    "read_block_ids": "SELECT -o_orderkey AS block_id FROM orders",
    # inventory
    "scan_files": """SELECT 'x' AS db, 't' || left(o_orderpriority, 1) AS tab, CAST(o_custkey % 3 AS VARCHAR) AS part, CAST(1 AS BIGINT) AS n_files,
          true AS filled FROM orders GROUP BY ALL""",
    "unlisted_folders": """SELECT tab, part, CAST(count(k) AS BIGINT) AS n_files, count(k) > 0 AS listed
        FROM (SELECT 't' || range AS tab FROM range(1, 6)), (SELECT CAST(range AS VARCHAR) AS part FROM range(6))
        LEFT JOIN (SELECT DISTINCT 't' || left(o_orderpriority, 1) AS k, CAST(o_custkey % 3 AS VARCHAR) AS kp FROM orders) ON k = tab AND kp = part
        GROUP BY ALL""",
    "files_by_table": f"WITH {FILES} SELECT db, tab, CAST(sum(length) AS BIGINT) AS n_bytes, count(*) AS n_files FROM f GROUP BY ALL",
    "dir_size": f"WITH {FILES} SELECT CAST(sum(length) AS BIGINT) AS n_bytes, count(*) AS n_files FROM f",
    "compaction_files": f"""WITH {FILES}, s AS (SELECT db, tab, CAST(sum(length) * 20 AS BIGINT) AS n FROM f GROUP BY ALL)
        SELECT db, tab, CASE WHEN n > 536870912 THEN greatest(1, n // 3 // 536870912) ELSE 1 END AS n_gzip,
          CASE WHEN n > 5368709120 THEN greatest(1, n // 3 // 5368709120) ELSE 1 END AS n_bzip2 FROM s""",
    "path_functions": f"""WITH {FILES} SELECT path, db, tab, tab AS third, 'part-' || key AS name,
          db || '.db/' || tab || '/part-' || key AS relative, path AS absolute, db || '_db_' || tab AS manifest,
          CASE WHEN length % 2 = 0 THEN '/warehouse_repl/' ELSE '/warehouse_text/' END || db || '.db/' || tab || '/part-' || key AS target
        FROM f""",
    "exclude_paths": f"WITH {FILES} SELECT path FROM f WHERE db NOT IN ('db0', 'db1')",
    "route_format": f"""WITH {FILES} SELECT path, CASE tab WHEN 't0' THEN 'text' WHEN 't1' THEN 'text_gzip' WHEN 't2' THEN 'parquet'
          WHEN 't3' THEN 'text' WHEN 't4' THEN 'text_gzip' ELSE 'orc' END AS format,
          CASE WHEN tab IN ('t0', 't1') THEN '5' WHEN tab IN ('t3', 't4') THEN '11' END AS n_cols FROM f""",
    "route_by_prefixes": f"""WITH {FILES}, p AS (SELECT db, tab, left(path, length(path) - 1) AS prefix, CASE o_orderstatus WHEN 'F' THEN 'text' WHEN 'O' THEN 'parquet' ELSE 'text_gzip' END AS format
          FROM f WHERE key % 10 = 3)
        SELECT f.path, coalesce(arg_max(p.format, length(p.prefix)), 'orc') AS format FROM f LEFT JOIN p ON p.db = f.db AND p.tab = f.tab AND starts_with(f.path, p.prefix) GROUP BY f.path""",
    "route_by_prefix": f"""WITH {FILES} SELECT path, CASE WHEN db = 'db4' OR (db = 'db3' AND tab = 't1') THEN 'parquet' ELSE 'orc' END AS format
        FROM f""",
    "pending": f"WITH {FILES} SELECT path FROM f WHERE o_orderstatus <> 'F'",
    "write_manifests": f"WITH {FILES} SELECT db, tab, path FROM f",
    "read_manifest": f"WITH {FILES} SELECT path FROM f",
    "rows_per_file": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in TABLES
    ),
    # content
    "check_parquet": PARQUET,
    "check_parquet_damaged": DAMAGED_PARTS,
    "check_parquet_values": DAMAGED_PARTS,
    "check_orc_damaged": DAMAGED_PARTS.replace("IN (1, 2)", "= 1"),
    "check_gzip_damaged": """SELECT CAST(c_custkey % 4 AS VARCHAR) AS part, c_custkey % 4 IN (1, 2) AS broken,
          CASE WHEN c_custkey % 4 IN (1, 2) OR bool_or(c_custkey % 13 = 0 OR c_custkey % 17 = 0) THEN -1 ELSE 0 END AS status
        FROM customer GROUP BY c_custkey % 4""",
    "check_orc": "SELECT left(o_orderpriority, 1) AS part, 0 AS status, count(*) AS n_rows FROM orders GROUP BY ALL",
    "read_orc": "SELECT o_orderkey, o_totalprice FROM orders",
    "read_delimited": """SELECT c_custkey AS key, CASE WHEN c_custkey % 13 = 0 THEN 2 WHEN c_custkey % 17 = 0 THEN 6 ELSE 5 END AS n
        FROM customer""",
    "text_field_check": f"WITH {CUSTOMER} {TEXT_VERDICT}",
    "text_field_check_wide": f"WITH {LINES} {TEXT_VERDICT}",
    "check_gzip": f"WITH {CUSTOMER} {TEXT_VERDICT}",
    "row_field_count": """SELECT CASE WHEN l_partkey % 23 = 0 THEN 4 WHEN l_partkey % 19 = 0 THEN 5 WHEN l_partkey % 29 = 0 THEN 13 ELSE 11 END
        AS n_fields, l_partkey % 23 <> 0 AS row_ok, count(*) AS n FROM lineitem GROUP BY ALL""",
    "probe_readable": """WITH o AS (SELECT DISTINCT CAST(o_orderkey % 4 AS VARCHAR) AS part FROM orders),
          c AS (SELECT CAST(c_custkey % 8 % 4 AS VARCHAR) AS part, CASE WHEN bool_or(c_custkey % 13 = 0 OR c_custkey % 17 = 0) THEN -1 ELSE 0 END AS status
            FROM customer GROUP BY ALL),
          found AS (SELECT unnest(['orc', 'parquet']) AS format, part, 0 AS status FROM o
            UNION ALL SELECT unnest(['text', 'text_gzip']), part, status FROM c)
        SELECT listing, format, part, status, status AS highest FROM found, (SELECT unnest(['tasks', 'spark']) AS listing)""",
    "probe_isolated": """WITH p AS (SELECT DISTINCT CAST(c_custkey % 8 AS VARCHAR) AS part FROM customer),
          f AS (SELECT unnest(['plain', 'packed']) AS kind, part, 0 AS status FROM p UNION ALL SELECT 'broken', '5', -1 UNION ALL SELECT 'gone', '9', 1)
        SELECT kind, part, status, status AS highest FROM f""",
    "word_count": r"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM documents)
        WHERE word <> '' GROUP BY word""",
    "line_functions": r"""SELECT conv_id, turn, regexp_matches(text, '[^\s]') AS visible,
          md5(trim(text, (SELECT string_agg(chr(CAST(range AS INTEGER)), '') FROM range(1, 33)))) AS trimmed,
          CAST(CASE WHEN text = '' THEN 1 WHEN rtrim(text, ',') = '' THEN 0
            ELSE length(rtrim(text, ',')) - length(replace(rtrim(text, ','), ',', '')) + 1 END AS INTEGER) AS n_fields
        FROM conversations""",
    # compaction and shards
    "compaction_proof": r"""WITH n AS (SELECT count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents))
        SELECT kind, n + CASE kind WHEN 'dropped' THEN -1 WHEN 'doubled' THEN 1 ELSE 0 END AS n_lines, kind = 'moved' AS same
        FROM n, (SELECT unnest(['moved', 'dropped', 'doubled', 'both']) AS kind)""",
    "compact_text": r"""SELECT md5(line) AS line, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents)
        GROUP BY ALL""",
    "shard_even": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, count(*) OVER () AS n FROM orders)
        SELECT o_orderkey, idx, CAST(CASE WHEN n < 7 THEN 7 ELSE least(idx // (n // 7), 7) END AS INTEGER) AS shard FROM r""",
    "shard_fixed": """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
        SELECT o_orderkey, idx, CAST(idx // 2000 + 1 AS INTEGER) AS shard FROM r""",
    "shard_skewed": """WITH r AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS idx, count(*) OVER () AS n FROM lineitem)
        SELECT CAST(least(idx // (n // 5), 5) AS INTEGER) AS shard, l_returnflag, count(*) AS n FROM r GROUP BY ALL""",
    "write_shards": """SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 500 + 1 AS INTEGER) AS shard, o_orderkey FROM orders""",
    # parity
    "parity_xor": "SELECT DISTINCT l_orderkey AS group_id, CASE WHEN l_orderkey % 37 = 0 THEN -1 ELSE 0 END AS status FROM lineitem",
    "parity_encode": f"""WITH RECURSIVE {GF}, {BYTES}, prod AS (
          SELECT group_id, stripe_no, i_row, i, CASE WHEN v = 0 THEN 0 ELSE q.x END AS x FROM bytes
            JOIN coef USING (unit) LEFT JOIN power p ON p.x = v LEFT JOIN power q ON q.e = (p.e + coef.e) % 255),
          folded AS (SELECT group_id, stripe_no, i_row, i, bit_xor(x) AS x FROM prod GROUP BY ALL)
        SELECT group_id, stripe_no, CAST(i_row + 6 AS INTEGER) AS unit_index, string_agg(printf('%02x', x), '' ORDER BY i) AS payload
        FROM folded GROUP BY group_id, stripe_no, i_row""",
    "parity_rs": f"WITH {STRIPES} SELECT * FROM bad_stripes",
    "parity_rs_screened": f"WITH {STRIPES} SELECT * FROM bad_stripes",
    "under_coded": """SELECT l_orderkey AS group_id, CAST(count(DISTINCT l_linenumber) AS INTEGER) AS n_units,
          CAST(least(6, (CAST(sum(l_quantity) AS BIGINT) - 1) // 16 + 1) + 1 AS INTEGER) AS n_required,
          count(DISTINCT l_linenumber) < least(6, (CAST(sum(l_quantity) AS BIGINT) - 1) // 16 + 1) + 1 AS under_coded
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""",
    "checkable": f"""WITH {FILES}, t AS (SELECT path, {META} AS why FROM f)
        SELECT path, CASE WHEN why IS NOT NULL THEN '1' END AS status, 'File ' || path || ' ' || why || '.' AS msg FROM t""",
    "group_verdict": f"""WITH {GROUPS}, {SEEN}, {FILES} SELECT group_id, path, CASE WHEN bad_p OR bad_d THEN -1 WHEN n_seen < n_stripes THEN 1 ELSE 0 END AS status,
          CASE WHEN bad_p OR bad_d THEN 'Status: ERROR, message: EC compute result not match.:ip is 10.0.6.' || (group_id % 200)
            || ' block is : ' || (group_id + 6) WHEN n_seen < n_stripes THEN 'not read completely' END AS msg,
          CASE WHEN bad_p OR bad_d THEN '10.0.6.' || (group_id % 200) END AS bad_host,
          CASE WHEN bad_p OR bad_d THEN CAST(group_id + 6 AS VARCHAR) END AS bad_block,
          CASE WHEN bad_d THEN '6,7,8' WHEN bad_p THEN '6' ELSE '' END AS bad_units
        FROM grp JOIN seen USING (group_id) JOIN f ON f.key = grp.group_id""",
    "file_audit": f"""WITH {GROUPS}, {SEEN}, {FILES}, t AS (SELECT key, path, {META} AS why FROM f),
          left_over AS (SELECT group_id, bool_or(bad_p OR bad_d) AS bad, count(*) FILTER (NOT (group_id % 53 = 0 AND stripe_no = 1)) AS n FROM s
            WHERE group_id % 47 <> 0 AND NOT (group_id % 5 = 0 AND stripe_no = 1) GROUP BY group_id),
          j AS (SELECT key, path, why, seen.group_id, why IS NULL AND coalesce(bad, false) AS bad,
              CASE WHEN seen.group_id IS NULL THEN key % 7 <> 0 ELSE key % 59 = 0 OR coalesce(n, 0) < n_stripes END AS unread
            FROM t LEFT JOIN seen ON seen.group_id = key LEFT JOIN left_over ON left_over.group_id = key)
        SELECT path, CASE WHEN why IS NOT NULL THEN 1 WHEN bad THEN -1 WHEN unread THEN 1 ELSE 0 END AS status,
          CASE WHEN why IS NOT NULL THEN 'File ' || path || ' ' || why || '.'
            WHEN bad THEN 'Status: ERROR, message: EC compute result not match.:ip is 10.0.6.' || (group_id % 200)
              || ' block is : ' || (group_id + 6) WHEN unread THEN 'not read completely' END AS msg,
          CASE WHEN bad THEN '10.0.6.' || (group_id % 200) END AS bad_host, CASE WHEN bad THEN CAST(group_id + 6 AS VARCHAR) END AS bad_block FROM j""",
    "file_audit_mixed": f"""WITH {FILES}, l AS (SELECT l_orderkey AS key, CASE l_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 6 END AS k, l_linenumber AS line FROM lineitem),
          g AS (SELECT key, k, key % 11 = 0 AND min(line) <= k AS bad, count(DISTINCT (line - 1) // k) < (max(line) - 1) // k + 1 AS unread FROM l GROUP BY key, k)
        SELECT path, CASE WHEN f.key % 4 = 3 THEN 1 WHEN bad THEN -1 WHEN unread THEN 1 ELSE 0 END AS status,
          CASE WHEN f.key % 4 <> 3 AND bad THEN 'h' || k END AS bad_host
        FROM f LEFT JOIN g USING (key)""",
    "unit_file_audit": f"""WITH {LONG}, st AS (SELECT g, stripe, bool_or(unit = 2 AND stripe % 4 = 0) AND g % 7 = 0 AS bad_d, g % 5 = 0 AS bad_p FROM l GROUP BY g, stripe),
          grp AS (SELECT g, g % 11 = 3 OR g % 13 = 4 AS unread, bool_or(bad_d OR bad_p) AS bad,
            arg_min(CASE WHEN bad_d THEN 'h6' ELSE 'h7' END, stripe) FILTER (bad_d OR bad_p) AS host FROM st GROUP BY g)
        SELECT '/w/g' || g AS path, CASE WHEN unread THEN 1 WHEN bad THEN -1 ELSE 0 END AS status, CASE WHEN NOT unread AND bad THEN host END AS bad_host FROM grp""",
    "unit_cells": f"""WITH {BYTES}, cell AS (
          SELECT group_id, stripe_no, unit AS unit_index, string_agg(printf('%02x', v), '' ORDER BY i) AS payload FROM bytes GROUP BY ALL)
        SELECT group_id // 250 AS group_id, CAST(group_id % 250 * 2 + stripe_no AS INTEGER) AS stripe_no, unit_index, payload FROM cell WHERE payload <> repeat('0', 32)""",
    "file_status": f"""WITH {RESULTS}, l AS (SELECT f.path, min(CASE WHEN l_quantity > 49 THEN -1 WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS s
          FROM lineitem JOIN f ON key = l_orderkey GROUP BY f.path)
        SELECT path, least(coalesce(s, 9), coalesce(c, 9), 1) AS status, CASE WHEN s IS NULL AND c IS NULL THEN 'not checked'
            WHEN c IS NULL OR s <= c THEN 'unit' END AS msg
        FROM (SELECT path, s, CASE WHEN status >= 0 THEN status END AS c FROM res LEFT JOIN l USING (path))""",
    "check_report": f"WITH {RESULTS} SELECT path || '===' || msg AS line FROM res WHERE status = -1",
    "report_summary": f"""WITH {RESULTS} SELECT count(*) FILTER (status <> 1) AS n_checked, count(*) FILTER (status = -1) AS n_bad,
        count(*) FILTER (status = 1) AS n_unchecked FROM res""",
    # recovery
    "parse_error_report": f"WITH {DAMAGED} SELECT path FROM dmg WHERE host IS NOT NULL",
    "suspect_hosts": f"WITH {FILES} SELECT path, CASE WHEN o_orderstatus = 'F' THEN '10.0.0.' || (o_custkey % 250) END AS host FROM f",
    "short_hosts": "SELECT CAST(l_suppkey AS VARCHAR) AS host, count(*) AS n FROM lineitem GROUP BY ALL",
    "hosts_of_groups": f"""WITH {HOSTS}, {FILES} SELECT path, string_agg(host, '_' ORDER BY host) AS hosts FROM r JOIN f ON f.key = r.g
        GROUP BY path""",
    "host_pairs": f"WITH {HOSTS}, {FILES} SELECT path, pair_no, pair FROM p JOIN f ON f.key = p.g",
    "attempt_plan": f"WITH {ATTEMPTS} SELECT g AS group_id, attempt_no, excluded FROM att",
    "attempt_plan_named_only": f"""WITH {ATTEMPTS} SELECT g AS group_id, count(*) AS n FROM att
        WHERE path IN (SELECT path FROM dmg WHERE host IS NOT NULL) GROUP BY g""",
    "group_attempts": f"WITH {TRIED} SELECT group_id, CAST(attempt_no AS INTEGER) AS attempt_no FROM tried",
    "recovery_outcome": f"WITH {TRIED} SELECT * FROM outc",
    "unrecoverable": f"WITH {TRIED} SELECT path FROM outc WHERE outcome = 'failed'",
    "repaired_payloads": f"""WITH {TRIED}, {BYTES}, cell AS (
          SELECT group_id, stripe_no, unit AS unit_index, string_agg(printf('%02x', v), '' ORDER BY i) AS payload FROM bytes GROUP BY ALL)
        SELECT cell.* FROM cell JOIN tried USING (group_id) JOIN outc USING (path) WHERE outcome = 'recovered' AND payload <> repeat('0', 32)""",
    "repaired_files": """WITH c AS (SELECT DISTINCT o_orderkey % 4 AS p, unnest(['t2', 't9']) AS tab FROM orders
          UNION ALL SELECT DISTINCT c_custkey % 4, unnest(['t0', 't1']) FROM customer)
        SELECT tab, CAST(p AS VARCHAR) AS part, CASE WHEN p = 2 THEN 'failed' ELSE 'recovered' END AS outcome, CASE WHEN p = 2 THEN 'failed' ELSE 'recovered' END AS highest,
          CASE p WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS attempt_no, p <> 2 AS same FROM c WHERE p > 0""",
    "located_per_stripe": f"""WITH {LONG}, st AS (SELECT g, stripe, bool_or(unit = stripe % 9) OR stripe % 9 > 5 AS hurt FROM l WHERE g % 3 = 0 GROUP BY g, stripe)
        SELECT g AS group_id, 'located_per_stripe' AS outcome, count(*) AS n_fixed, count(*) AS n_same FROM st WHERE hurt GROUP BY g""",
    "refused_groups": """SELECT l_orderkey AS group_id, 'too many units' AS reason FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) > 3""",
    "report_is_kept": f"WITH {RESULTS} SELECT count(*) AS n_damaged, false AS written_again FROM res WHERE status = -1",
    "reconstruct": f"""WITH {BYTES}, st AS (SELECT DISTINCT group_id, stripe_no FROM bytes), want AS (
          SELECT group_id, stripe_no, unit, i FROM st, (SELECT CAST(range AS INTEGER) AS unit FROM range(3)), pos)
        SELECT group_id, stripe_no, unit AS unit_index, string_agg(printf('%02x', coalesce(v, 0)), '' ORDER BY i) AS payload
        FROM want LEFT JOIN bytes USING (group_id, stripe_no, unit, i) GROUP BY ALL""",
    "locate_bad_units": f"""WITH {GROUPS} SELECT group_id, 'located' AS outcome,
        CASE WHEN bad_p AND bad_d THEN '0,6' WHEN bad_p THEN '6' ELSE '0' END AS unit_sets FROM grp WHERE bad_p OR bad_d""",
    "candidate_units": """SELECT DISTINCT l_orderkey AS group_id, CAST(u.range + 1 AS INTEGER) AS attempt_no, CAST(u.range AS VARCHAR) AS excluded
        FROM lineitem, range(8) u WHERE l_orderkey % 37 = 0""",
    "verified_repair": f"WITH {GROUPS} SELECT group_id, true AS ok FROM grp WHERE bad_p OR bad_d",
}
ORACLES["publish_manifests"] = ORACLES["write_manifests"]
ORACLES["compact_text_bzip2"] = ORACLES["compact_text"]
ORACLES["scan_all_files"] = ORACLES["scan_files"]
