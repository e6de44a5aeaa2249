"""Queries that go through the database's own operations (records, links, vectors, transactions, export, follow) over small adopted tables, each
with DuckDB SQL for the state that it must leave or the rows that it must give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FourfoldError
from ..functions import values as V
from ..operators import vectors
from ..sources.database import Database
from ..sources.files import scratch
from ..sources.jsonl import export, import_
from ..sources.tables import table
from ..streaming.follow import Follower
from .catalog import _DIST, _Q
from .statements import KEYS, adopted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return add


def fresh(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """A database of its own with the tables adopted."""
    db = Database(spark, f"{scratch(spark)}/records-{uuid.uuid4().hex}")
    for name in names:
        db.adopt(name, table(spark, sf_dir, name), KEYS[name])
    return db


def _placed(db: Database) -> None:
    """supplier -> nation, as links."""
    rows = db.snapshot().table("supplier")
    db.add_links(rows.select(F.col("key").alias("src"), F.lit("at").alias("type"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst")))


_SUPPLIER = "SELECT 'supplier:' || s_suppkey AS key, s_name, s_acctbal FROM supplier"


@query("SELECT 'supplier:' || s_suppkey AS key, CASE WHEN s_suppkey < 3 THEN 'new' ELSE s_name END AS s_name, CASE WHEN s_suppkey <> 1 THEN s_acctbal END AS s_acctbal, CASE WHEN s_suppkey < 3 THEN CAST(s_suppkey * 2 AS BIGINT) END AS extra FROM supplier UNION ALL SELECT 'supplier:x', NULL, 1.5, 7")
def record_put(spark, d):
    """Given fields replace, others stay, None clears, new fields and records appear; in one transaction, with a mark rolled back."""
    db = fresh(spark, d, "supplier")
    with db.begin() as tx:
        for i in range(3):
            tx.put(f"supplier:{i}", {"s_name": "new", "extra": i * 2})
        tx.put("supplier:1", {"s_acctbal": None})
        mark = tx.mark()
        tx.delete("supplier:2")
        tx.put("supplier:lost", {"s_name": "never"})
        tx.rollback_to(mark)
        tx.put("supplier:x", {"s_acctbal": 1.5, "extra": 7})
    return db.snapshot().table("supplier").select("key", "s_name", "s_acctbal", "extra")


@query("SELECT 'supplier:' || s_suppkey AS key, s_name, CAST(s_nationkey AS BIGINT) AS at FROM supplier WHERE s_suppkey IN (0, 3, 4)")
def record_get(spark, d):
    """Records one by one, by key."""
    db = fresh(spark, d, "supplier")
    found = [(k, db.get(k)) for k in ("supplier:0", "supplier:3", "supplier:4")]
    return spark.createDataFrame([(k, r["s_name"], r["s_nationkey"]) for k, r in found], "key string, s_name string, at long")


@query("SELECT 'links' AS what, count(*) AS n FROM supplier WHERE s_suppkey > 2 AND s_nationkey <> 7 UNION ALL SELECT 'nations', count(*) FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'suppliers', count(*) FROM supplier WHERE s_suppkey > 2")
def record_delete(spark, d):
    """A record takes its links along, both ways."""
    db = fresh(spark, d, "supplier", "nation")
    _placed(db)
    db.update(lambda tx: [tx.delete(k) for k in ("supplier:0", "supplier:1", "supplier:2", "nation:7")])
    s = db.snapshot()
    return spark.createDataFrame([("links", s.links().count()), ("nations", s.table("nation").count()), ("suppliers", s.table("supplier").count())], "what string, n long")


@query("SELECT 'nation' AS name, count(*) AS n, CAST(0 AS BIGINT) AS links FROM nation")
def record_drop(spark, d):
    db = fresh(spark, d, "supplier", "nation")
    _placed(db)
    db.drop("supplier")
    s = db.snapshot()
    return spark.createDataFrame([(t, s.table(t).count(), s.links().count()) for t in s.tables()], "name string, n long, links long")


@query(f"{_SUPPLIER} WHERE s_suppkey >= 2")
def record_snapshot(spark, d):
    """A pinned snapshot sees neither later commits nor a compaction; the deletion before it holds."""
    db = fresh(spark, d, "supplier")
    db.execute("DELETE FROM supplier WHERE s_suppkey < 2")
    pinned = db.snapshot()
    db.put("supplier:late", {"s_name": "late"})
    before = pinned.table("supplier").count()
    db.compact()
    assert before == db.snapshot().table("supplier").count() - 1
    return pinned.sql("SELECT key, s_name, s_acctbal FROM supplier") if pinned.manifest.version in db._versions() else db.query("SELECT key, s_name, s_acctbal FROM supplier WHERE key <> 'supplier:late'")


@query(_SUPPLIER)
def record_failed_write(spark, d):
    """What fails leaves nothing: a transaction that raises, a statement with one bad row, a link without an end."""
    db = fresh(spark, d, "supplier")

    def failing(tx):
        tx.put("supplier:0", {"s_name": "lost"})
        raise RuntimeError

    for bad in (
        lambda: db.update(failing),
        lambda: db.execute("INSERT INTO supplier (key, s_name) VALUES ('supplier:n', 'n'), ('supplier:1', 'taken')"),
        lambda: db.execute("INSERT INTO supplier (key, s_name) SELECT 'nation:' || s_suppkey, s_name FROM supplier"),
        lambda: db.update(lambda tx: [tx.put("supplier:0", {"s_name": "lost"}), tx.link("supplier:0", "to", "supplier:none")]),
        lambda: db.put("supplier:0", {"s_name": "x", "S_NAME": "y"}),
        lambda: db.put("supplier:0", {"s_acctbal": float("inf")}),
        lambda: db.put("supplier:", {}),
    ):
        try:
            bad()
        except (FourfoldError, RuntimeError):
            continue
        raise AssertionError("this write is wrong")
    return db.snapshot().table("supplier").select("key", "s_name", "s_acctbal")


@query("SELECT n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 'nation:' || n_nationkey AS key FROM nation")
def record_export_import(spark, d):
    """Out as JSON Lines and in again, links included."""
    db = fresh(spark, d, "supplier", "nation")
    _placed(db)
    at = f"{scratch(spark)}/export-{uuid.uuid4().hex}"
    export(db.snapshot(), at)
    copy = Database(spark, f"{scratch(spark)}/records-{uuid.uuid4().hex}")
    counts = import_(copy, at)
    assert counts["links"] == db.snapshot().links().count() == copy.snapshot().links().count() and copy.check() == db.check()
    return copy.snapshot().table("nation").select("n_name", "n_regionkey", "key")


@query("SELECT 'supplier:' || s_suppkey AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS s_name FROM supplier")
def record_follow(spark, d):
    """A follower sees each commit's changes once and in order; their fold is the state."""
    db, seen = fresh(spark, d, "supplier"), []
    follower = Follower(db, db.snapshot().manifest.version)
    db.execute("UPDATE supplier SET s_name = 'odd'")
    follower.poll(lambda name, changes: seen.append(changes.select("key", "s_name")))
    db.execute("UPDATE supplier SET s_name = 'even' WHERE s_suppkey % 2 = 0")
    follower.poll(lambda name, changes: seen.append(changes.select("key", "s_name")))
    assert len(seen) == 2 and follower.poll(lambda *_: None) == 0
    ordered = seen[0].withColumn("n", F.lit(1)).unionAll(seen[1].withColumn("n", F.lit(2)))
    return ordered.groupBy("key").agg(F.max_by("s_name", "n").alias("s_name"))


@query("SELECT 'nation:' || n_nationkey AS key, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey <> 1 GROUP BY 1 HAVING n > 0 UNION ALL SELECT 'twice', 0")
def record_link(spark, d):
    """Links one by one: a second time changes nothing, unlink takes one or all between two records; read in the order of dst after a compaction."""
    db = fresh(spark, d, "supplier", "nation")
    _placed(db)
    at = db.neighbours("supplier:1")[0][2]
    db.update(lambda tx: [tx.link("supplier:1", t, at) for t in ("by", "by", "at")])
    db.unlink("supplier:1", "at", at)
    db.unlink("supplier:1", "", at)
    twice = len(db.neighbours("supplier:1", "both"))
    db.compact()
    back = db.snapshot().links("dst")
    return back.groupBy(F.col("dst").alias("key")).agg(F.count("*").alias("n")).unionAll(spark.createDataFrame([("twice", twice)], "key string, n long"))


@query("SELECT 'supplier:' || s_suppkey AS key, CAST(1 AS INTEGER) AS depth FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 0) UNION ALL SELECT 'nation:' || n_nationkey, 0 FROM nation WHERE n_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 0)")
def record_walk_in(spark, d):
    """Backwards along stored links, after a compaction: all that lead to one record."""
    db = fresh(spark, d, "supplier", "nation")
    _placed(db)
    db.compact()
    start = db.neighbours("supplier:0")[0][2]
    walked = spark.createDataFrame(db.walk(start, 2, "at", "in"), "key string, depth int")
    return walked.unionAll(spark.createDataFrame([(start, 0)], "key string, depth int"))


@query(f"SELECT 'v:' || vec_id AS key, round({_DIST.format('embedding', _Q)}, 6) AS distance FROM embeddings WHERE label <> 2 ORDER BY {_DIST.format('embedding', _Q)}, 'v:' || vec_id LIMIT 12")
def record_nearest(spark, d):
    """Nearest of stored vectors with their stored norms, filtered, to a record's own vector."""
    db = Database(spark, f"{scratch(spark)}/records-{uuid.uuid4().hex}")
    db.adopt("v", table(spark, d, "embeddings"), "vec_id", vec="embedding")
    return db.snapshot().nearest("v", "v:3", 12, "label <> 2").select("key", F.round("distance", 6).alias("distance"))


@query(f"SELECT 'v:' || vec_id AS key, CAST(label AS BIGINT) AS label FROM embeddings WHERE label = 1 ORDER BY {_DIST.format('embedding', _Q)}, 'v:' || vec_id LIMIT 5")
def record_nearest_sql(spark, d):
    """The same as a statement, its query vector an argument."""
    db = Database(spark, f"{scratch(spark)}/records-{uuid.uuid4().hex}")
    db.adopt("v", table(spark, d, "embeddings"), "vec_id", vec="embedding")
    q = db.get("v:3")["vec"]
    return db.query("SELECT key, label FROM v WHERE vec IS NOT NULL AND label = 1 ORDER BY distance(vec, ?), key LIMIT 5", (list(q),))


@query("SELECT vec_id, CAST(list_sum(CAST(embedding AS DOUBLE[])) AS DOUBLE) IS NOT NULL AS ok, len(embedding) * 4 AS bytes FROM embeddings")
def vector_codec(spark, d):
    """Vectors as little-endian bytes and back, as JSON text and back."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def turn(batches):
        import pyarrow as pa

        for batch in batches:
            ok, size = [], []
            for v in batch.column(1).to_pylist():
                raw = vectors.to_bytes(v)
                ok.append(vectors.from_bytes(raw) == v)
                size.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok), pa.array(size, pa.int64())], ["vec_id", "ok", "bytes"])

    return rows.mapInArrow(turn, "vec_id long, ok boolean, bytes long")


@query("SELECT p_partkey AS k, abs(CAST(p_size - 25 AS BIGINT)) AS a, CAST(length(p_name) AS BIGINT) AS l, coalesce(nullif(CAST(p_size AS BIGINT), 7), -1) AS c, CAST(-p_size AS BIGINT) AS m, p_name || '/' || p_size AS t, round(p_retailprice, 1) AS r, CASE WHEN nullif(p_size, 7) IS NULL THEN 'null' ELSE 'integer' END AS y, CAST(p_size * 3 + 1 AS BIGINT) AS x, upper(p_brand) AS u, CAST(p_retailprice AS BIGINT) - CASE WHEN CAST(p_retailprice AS BIGINT) > p_retailprice THEN 1 ELSE 0 END AS i FROM part")
def sql_scalars(spark, d):
    """Scalar functions and operators of the subset, in a statement over stored records."""
    return adopted(spark, d).query("SELECT p_partkey AS k, abs(p_size - 25) AS a, length(p_name) AS l, ifnull(nullif(p_size, 7), -1) AS c, -p_size AS m, p_name || '/' || p_size AS t, round(p_retailprice, 1) AS r, typeof(nullif(p_size, 7)) AS y, p_size * 3 + 1 AS x, upper(p_brand) AS u, CAST(p_retailprice AS INTEGER) AS i FROM part")


@query("SELECT CAST(1 AS BIGINT) AS one, CAST(NULL AS BIGINT) AS nothing, CAST(9223372036854775808.0 AS DOUBLE) AS big, 2.5::DOUBLE AS arg, strftime(current_date, '%Y-%m-%d') AS today, CAST(1 AS BIGINT) AS same")
def sql_one_row(spark, d):
    """No FROM: literals, an argument, a promoted overflow, the statement's moment."""
    return adopted(spark, d).query("SELECT 1 AS one, NULL + 1 AS nothing, 9223372036854775807 + 1 AS big, ? AS arg, date('now') AS today, date('now') = substr(datetime('now'), 1, 10) AS same", (2.5,))


@query("SELECT n_name FROM nation WHERE false")
def sql_empty(spark, d):
    """LIMIT 0, a term that is false before any row, an empty list."""
    return adopted(spark, d).query("SELECT n_name FROM nation WHERE n_nationkey IN () OR 1 = 2 LIMIT 0")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_nationkey = 3) AND c_acctbal IS NOT NULL ORDER BY c_acctbal DESC, 'customer:' || c_custkey LIMIT 7")
def sql_subquery_order(spark, d):
    """IN over the one-record subquery, ORDER BY an alias, a number and an expression, the key as the last tie-breaker."""
    return adopted(spark, d).query("SELECT c_custkey, c_acctbal AS b FROM customer WHERE c_nationkey IN ((SELECT n_nationkey FROM nation WHERE key = 'nation:3')) AND (c_acctbal IS NOT NULL) IS NOT 0 ORDER BY b DESC LIMIT 7").select("c_custkey")


@query("SELECT CAST(sum(CASE WHEN regexp_matches(p_name, '^[0-9]') THEN 1 ELSE 0 END) AS DOUBLE) AS s, coalesce(avg(0.0), 0) AS a, CAST(count(*) AS BIGINT) AS n FROM part")
def sql_text_in_sum(spark, d):
    """Text in sum() and avg() counts by its number prefix."""
    return adopted(spark, d).query("SELECT sum(p_name) AS s, avg(p_name) AS a, count(p_name) AS n FROM part")


@query("SELECT p_partkey, round(p_retailprice * 1.015, 2) AS r FROM part WHERE abs(p_retailprice * 101.5 - floor(p_retailprice * 101.5) - 0.5) > 1e-6")
def round_places(spark, d):
    """Rounded to places as the exact binary value reads in decimal; values halfway between are left out."""
    p = F.col("p_retailprice")
    rows = table(spark, d, "part").where(F.abs(p * 101.5 - F.floor(p * 101.5) - 0.5) > 1e-6)
    return rows.select("p_partkey", V.round_(p * 1.015, F.lit(2)).alias("r"))


@query("SELECT CAST(1 AS BIGINT) AS tables, count(*) AS records, CAST(0 AS BIGINT) AS problems FROM supplier")
def record_check(spark, d):
    report = fresh(spark, d, "supplier").check()
    return spark.createDataFrame([(report["tables"], report["records"], len(report["problems"]))], "tables long, records long, problems long")
