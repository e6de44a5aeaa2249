"""SQL texts that run through ``Database.query`` and ``Database.execute`` over a database of adopted tables, each with DuckDB SQL for the same rows.

The database holds nation, customer, orders, part, supplier and events as record tables and the links customer -> orders ("placed"); it is made once a
session and folder, in the scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.database import Database
from ..sources.files import scratch
from ..sources.tables import table

KEYS = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}
_MADE: dict[tuple[str, str], str] = {}


def adopted(spark: SparkSession, sf_dir: str) -> Database:
    at = (spark._jsparkSession.sessionUUID(), sf_dir)
    if at in _MADE and (db := Database(spark, _MADE[at])).snapshot().tables():
        return db
    db = Database(spark, f"{scratch(spark)}/statements-{uuid.uuid4().hex}")
    for name, key in KEYS.items():
        db.adopt(name, table(spark, sf_dir, name), key)
    db.add_links(table(spark, sf_dir, "orders").select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.lit("placed").alias("type"), F.concat(F.lit("orders:"), "o_orderkey").alias("dst")))
    _MADE[at] = db.path
    return db


_T = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: name: (SQL of the engine, DuckDB SQL).
SELECTS: dict[str, tuple[str, str]] = {
    "sql_group_by": (
        "SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal > 0) AS rich, total(c_nationkey) AS t FROM customer GROUP BY 1 HAVING n > 3 ORDER BY k",
        "SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS rich, CAST(sum(c_nationkey) AS DOUBLE) AS t FROM customer GROUP BY 1 HAVING count(*) > 3",
    ),
    "sql_bare_column": (
        "SELECT c_nationkey AS k, c_custkey AS who, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey",
        "SELECT CAST(c_nationkey AS BIGINT) AS k, arg_max(c_custkey, c_acctbal) AS who, max(c_acctbal) AS most FROM customer GROUP BY c_nationkey",
    ),
    "sql_comma_join": (
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    ),
    "sql_left_join": (
        "SELECT c.c_custkey, count(o.key) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
        "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    ),
    "sql_using": (
        "SELECT n_name, c FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) USING (n_nationkey)",
        "SELECT n_name, c FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) USING (n_nationkey)",
    ),
    "sql_distinct": ("SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "sql_case": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 END AS done, iif(o_custkey % 2, 'odd', 'even') AS parity FROM orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN CAST(1 AS BIGINT) END AS done, CASE WHEN o_custkey % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM orders",
    ),
    "sql_with": (
        "WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 150000), per(k, n) AS (SELECT k, count(*) FROM big GROUP BY k) SELECT c.c_name, per.n FROM customer c JOIN per ON per.k = c.c_custkey",
        "WITH big AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 150000) SELECT c_name, count(*) AS n FROM customer JOIN big ON k = c_custkey GROUP BY c_custkey, c_name",
    ),
    "sql_recursive": (
        "WITH RECURSIVE c(i, f) AS (SELECT 1, 1 UNION ALL SELECT i + 1, f * (i + 1) FROM c WHERE i < 12) SELECT i, f FROM c",
        "WITH RECURSIVE c(i, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM c WHERE i < 12) SELECT i, f FROM c",
    ),
    "sql_windows": (
        "SELECT o_orderkey, row_number() OVER w AS rn, percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pr, cume_dist() OVER w AS cd, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (ORDER BY o_orderkey RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near, lag(o_orderkey, 1, -1) OVER w AS prev FROM orders WHERE o_custkey < 200 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
        "SELECT o_orderkey, row_number() OVER w AS rn, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, count(*) OVER (ORDER BY o_orderkey RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near, lag(o_orderkey, 1, -1) OVER w AS prev FROM orders WHERE o_custkey < 200 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    ),
    "sql_union": ("SELECT key FROM customer UNION SELECT key FROM customer UNION ALL SELECT key FROM nation", "SELECT 'customer:' || c_custkey AS key FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation"),
    "sql_except_walk": (
        "SELECT key FROM orders EXCEPT SELECT value FROM json_each(walk('customer:7', 1))",
        "SELECT 'orders:' || o_orderkey AS key FROM orders WHERE o_custkey <> 7",
    ),
    "sql_intersect": ("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"),
    "sql_scalar_subquery": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) * 1.5"),
    "sql_correlated": (
        "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS most FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
        "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS most FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    ),
    "sql_in_subquery": (
        "SELECT c_custkey FROM customer WHERE key IN (SELECT src FROM links WHERE type = 'placed') AND c_name NOT IN (SELECT n_name FROM nation) AND c_custkey NOT IN (SELECT n_name FROM nation)",
        "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    ),
    "sql_derived": ("SELECT * FROM (SELECT p_size / 3 AS third, p_size % 7 AS rest, p_size / (p_size - p_size) AS none FROM part) WHERE third > 4", "SELECT CAST(p_size // 3 AS BIGINT) AS third, CAST(p_size % 7 AS BIGINT) AS rest, CAST(NULL AS BIGINT) AS none FROM part WHERE p_size // 3 > 4"),
    "sql_values": ("VALUES (1, 'a', 2.5), (2, NULL, -1.0)", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(2.5 AS DOUBLE)), (2, NULL, -1.0)) v(column1, column2, column3)"),
    "sql_dates": (
        "SELECT o_orderkey, date(o_orderdate, '+1 day') AS d, date(o_orderdate, 'start of month', '-1 day') AS e, strftime('%Y/%m %j %w %H:%M', o_orderdate, '+90 minutes') AS s, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j, datetime(o_orderdate, '+1 month') AS m, time(o_orderdate, '-1 second') AS t FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS d, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS e, strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y/%m %j %w %H:%M') AS s, CAST(epoch(o_orderdate) AS BIGINT) AS u, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + INTERVAL (day(o_orderdate) - 1) DAY + (o_orderdate - date_trunc('day', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS m, strftime(o_orderdate - INTERVAL 1 SECOND, '%H:%M:%S') AS t FROM orders",
    ),
    "sql_json": (
        "SELECT event_id, json_extract(props, '$.k') AS k, props ->> 'k' AS v, json_valid(props) AS ok, json_object('id', event_id, 'type', event_type, 'none', NULL) AS o, json_array(event_id, event_type) AS a, json_type(props) AS t FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS k, props ->> '$.k' AS v, CAST(json_valid(props) AS BIGINT) AS ok, CAST(json_object('id', event_id, 'type', event_type, 'none', NULL) AS VARCHAR) AS o, CAST(json_array(event_id, event_type) AS VARCHAR) AS a, lower(json_type(props)) AS t FROM events",
    ),
    "sql_json_each": (
        "SELECT n.n_nationkey AS n, j.key AS i, j.value AS v FROM nation n, json_each('[' || n.n_nationkey || ',\"' || n.n_name || '\"]') j",
        "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(i AS BIGINT) AS i, CASE i WHEN 0 THEN CAST(n_nationkey AS VARCHAR) ELSE n_name END AS v FROM nation, range(2) r(i)",
    ),
    "sql_json_group": (
        "SELECT n_regionkey AS r, json_group_object(n_name, n_nationkey) AS o, json_group_array(n_regionkey) AS a FROM nation GROUP BY n_regionkey HAVING count(*) < 2 OR 1",
        "SELECT CAST(n_regionkey AS BIGINT) AS r, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY 'nation:' || n_nationkey) || '}' AS o, '[' || string_agg(n_regionkey, ',') || ']' AS a FROM nation GROUP BY n_regionkey",
    ),
    "sql_group_concat": (
        "SELECT n_regionkey AS r, group_concat(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS keys, count(DISTINCT n_name) FILTER (WHERE n_nationkey > 5) AS some FROM nation GROUP BY n_regionkey",
        "SELECT CAST(n_regionkey AS BIGINT) AS r, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(n_nationkey, ',' ORDER BY n_nationkey) AS keys, count(DISTINCT n_name) FILTER (WHERE n_nationkey > 5) AS some FROM nation GROUP BY n_regionkey",
    ),
    "sql_bits": (
        "SELECT p_partkey AS k, p_size & 12 AS a, p_size | 1 AS b, p_size << 3 AS c, ~p_size AS d, -p_size >> 1 AS e FROM part",
        "SELECT p_partkey AS k, CAST(p_size & 12 AS BIGINT) AS a, CAST(p_size | 1 AS BIGINT) AS b, CAST(p_size AS BIGINT) * 8 AS c, CAST(-p_size - 1 AS BIGINT) AS d, CAST(floor(-p_size / 2.0) AS BIGINT) AS e FROM part",
    ),
    "sql_text": (
        "SELECT p_partkey AS k, printf('%05d|%s', p_size, p_name) AS p, hex(p_name) AS h, unicode(p_name) AS u, char(65, p_size + 64) AS c, quote(p_name) AS q, concat_ws('-', p_brand, nullif(p_size, 7)) AS w, rtrim(p_brand, '0123456789') AS r, sign(p_retailprice - 1000) AS s, octet_length(p_type) AS o, p_retailprice || '' AS t FROM part",
        "SELECT p_partkey AS k, printf('%05d|%s', p_size, p_name) AS p, hex(p_name) AS h, CAST(unicode(p_name) AS BIGINT) AS u, 'A' || chr(p_size + 64) AS c, chr(39) || replace(p_name, chr(39), chr(39) || chr(39)) || chr(39) AS q, concat_ws('-', p_brand, nullif(p_size, 7)) AS w, rtrim(p_brand, '0123456789') AS r, CAST(sign(p_retailprice - 1000) AS BIGINT) AS s, CAST(strlen(p_type) AS BIGINT) AS o, CAST(p_retailprice AS VARCHAR) AS t FROM part",
    ),
    "sql_glob": ("SELECT p_partkey FROM part WHERE p_name GLOB '*[a-e]* ?i*' OR p_name REGEXP '^s.*g$'", "SELECT p_partkey FROM part WHERE p_name GLOB '*[a-e]* ?i*' OR regexp_matches(p_name, '^s.*g$')"),
    "sql_collate": (
        "SELECT c_custkey FROM customer WHERE c_mktsegment = 'Building' COLLATE NOCASE AND c_mktsegment <> 'building'",
        "SELECT c_custkey FROM customer WHERE " + _T.format("c_mktsegment") + " = 'building' AND c_mktsegment <> 'building'",
    ),
    "sql_nulls_last": ("SELECT key FROM part ORDER BY nullif(p_size, 7) DESC NULLS FIRST, key LIMIT 5, 20", "SELECT 'part:' || p_partkey AS key FROM part ORDER BY nullif(p_size, 7) DESC NULLS FIRST, key LIMIT 20 OFFSET 5"),
    "sql_kinds": (
        "SELECT count(*) AS n FROM part WHERE p_size = '7' OR p_name < 5 OR p_size > 'a' OR typeof(p_retailprice) <> 'real' OR p_size IS 'x'",
        "SELECT CAST(0 AS BIGINT) AS n",
    ),
    "sql_links": ("SELECT src, type, count(*) AS n FROM hc_links GROUP BY src, type", "SELECT 'customer:' || o_custkey AS src, 'placed' AS type, count(*) AS n FROM orders GROUP BY 1"),
    "sql_walk_group": (
        "SELECT o.o_orderstatus AS s, count(*) AS n, max(w.depth) AS d FROM walk('customer:7', 2) w JOIN orders o ON o.key = w.key GROUP BY o.o_orderstatus",
        "SELECT o_orderstatus AS s, count(*) AS n, CAST(1 AS BIGINT) AS d FROM orders WHERE o_custkey = 7 GROUP BY 1",
    ),
    "sql_schema": ("SELECT name FROM sqlite_schema WHERE type = 'table'", "SELECT unnest(['customer', 'events', 'nation', 'orders', 'part', 'supplier']) AS name"),
    "sql_table_info": ("PRAGMA table_info(nation)", "SELECT * FROM (VALUES (0, 'key', 'TEXT', 1), (1, 'n_nationkey', 'INTEGER', 0), (2, 'n_name', 'TEXT', 0), (3, 'n_regionkey', 'INTEGER', 0)) v(cid, name, type, pk)"),
}
#: name: (write statements on a database with the one table, the table, the query for what they leave, DuckDB SQL).
WRITES: dict[str, tuple[list[str], str, str, str]] = {
    "sql_insert_select": (
        ["INSERT INTO supplier (key, s_suppkey, s_name) SELECT 'supplier:' || (s_suppkey + 1000000), s_suppkey, upper(s_name) FROM supplier WHERE s_acctbal > 5000"],
        "supplier",
        "SELECT key, s_name, s_acctbal FROM supplier",
        "SELECT 'supplier:' || s_suppkey AS key, s_name, s_acctbal FROM supplier UNION ALL SELECT 'supplier:' || (s_suppkey + 1000000), upper(s_name), NULL FROM supplier WHERE s_acctbal > 5000",
    ),
    "sql_upsert": (
        ["INSERT INTO supplier (key, s_name, s_acctbal) SELECT 'supplier:' || (s_suppkey * 2), 'new', 1.5 FROM supplier WHERE 1 ON CONFLICT (key) DO UPDATE SET s_acctbal = s_acctbal + excluded.s_acctbal, s_name = excluded.s_name || '/' || s_name WHERE s_nationkey > 3"],
        "supplier",
        "SELECT key, s_name, round(s_acctbal, 2) AS b FROM supplier",
        "WITH g AS (SELECT s_suppkey * 2 AS k FROM supplier) SELECT 'supplier:' || coalesce(s_suppkey, k) AS key, CASE WHEN s_suppkey IS NULL THEN 'new' WHEN k IS NOT NULL AND s_nationkey > 3 THEN 'new/' || s_name ELSE s_name END AS s_name, round(CASE WHEN s_suppkey IS NULL THEN 1.5 WHEN k IS NOT NULL AND s_nationkey > 3 THEN s_acctbal + 1.5 ELSE s_acctbal END, 2) AS b FROM supplier FULL JOIN g ON k = s_suppkey",
    ),
    "sql_replace": (
        ["REPLACE INTO supplier (key, s_name) SELECT key, 'r' FROM supplier WHERE s_suppkey % 3 = 0", "INSERT OR IGNORE INTO supplier (key, s_name) SELECT key, 'i' FROM supplier"],
        "supplier",
        "SELECT key, s_name, s_acctbal FROM supplier",
        "SELECT 'supplier:' || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'r' ELSE s_name END AS s_name, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal END AS s_acctbal FROM supplier",
    ),
    "sql_update_delete": (
        ["UPDATE supplier SET s_acctbal = (SELECT max(s_acctbal) FROM supplier) WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", "DELETE FROM supplier WHERE key IN (SELECT key FROM supplier ORDER BY s_suppkey LIMIT 5)"],
        "supplier",
        "SELECT key, s_acctbal FROM supplier",
        "SELECT 'supplier:' || s_suppkey AS key, CASE WHEN s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) THEN (SELECT max(s_acctbal) FROM supplier) ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 5)",
    ),
}


def selecting(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return adopted(spark, sf_dir).query(text)

    return query


def writing(statements: list[str], name: str, text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, f"{scratch(spark)}/writes-{uuid.uuid4().hex}")
        db.adopt(name, table(spark, sf_dir, name), KEYS[name])
        for s in statements:
            db.execute(s)
        return db.query(text)

    return query


QUERIES = {n: selecting(q) for n, (q, _) in SELECTS.items()} | {n: writing(*w[:3]) for n, w in WRITES.items()}
ORACLES = {n: o for n, (_, o) in SELECTS.items()} | {n: w[3] for n, w in WRITES.items()}
