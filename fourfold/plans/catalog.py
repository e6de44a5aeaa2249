"""Registry of the library's queries, one per operator, and of the DuckDB SQL that each is compared with.

Results are whole; a limit is there only where top-k or paging is the operator. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extra as X
from ..functions import values as V
from ..operators import graph, vectors
from ..sources.tables import table
from ..streaming import events as E
from .model import links, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Links and vectors in SQL.
_EDGES = """
  placed AS (SELECT 'customer:' || o_custkey AS src, 'placed' AS type, 'orders:' || o_orderkey AS dst FROM orders),
  contains AS (SELECT DISTINCT 'orders:' || l_orderkey AS src, 'contains' AS type, 'part:' || l_partkey AS dst FROM lineitem),
  isin AS (SELECT 'customer:' || c_custkey AS src, 'in' AS type, 'nation:' || c_nationkey AS dst FROM customer
           UNION ALL SELECT 'nation:' || n_nationkey, 'in', 'region:' || n_regionkey FROM nation),
  nd AS (SELECT count(*) AS n FROM documents),
  reads AS (SELECT 'customer:' || c_custkey AS src, 'reads' AS type, 'documents:' || (c_custkey % n) AS dst FROM customer, nd),
  cites AS (SELECT 'documents:' || doc_id AS src, 'cites' AS type, 'documents:' || ((doc_id * 7 + 1) % n) AS dst FROM documents, nd)"""


def _walk_sql(start: str, depth: int, edges: str, both: bool = False, back: bool = False) -> str:
    """CTEs ending in w(key, depth)."""
    one = f"SELECT src AS a, dst AS b FROM ({edges})"
    two = f"SELECT dst AS a, src AS b FROM ({edges})"
    e = f"{one} UNION ALL {two}" if both else two if back else one
    return f"WITH RECURSIVE {_EDGES}, e AS ({e}), r AS (SELECT '{start}' AS key, 0 AS depth UNION SELECT e.b, depth + 1 FROM r JOIN e ON e.a = r.key WHERE depth < {depth}), w AS (SELECT key, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY key HAVING min(depth) > 0)"


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
_DIST = "greatest(0.0, least(2.0, 1 - list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))))"


def _vector(spark: SparkSession, d: str, vec_id: int) -> list[float]:
    return table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


# Graph.
@query(_walk_sql("customer:7", 3, "SELECT * FROM reads UNION ALL SELECT * FROM cites")
       + f" SELECT key, depth, round({_DIST.format('embedding', _Q)}, 6) AS distance FROM w JOIN documents d ON w.key = 'documents:' || d.doc_id JOIN embeddings v ON v.vec_id = d.doc_id WHERE d.lang IN ('en', 'fr', 'de', 'es') ORDER BY {_DIST.format('embedding', _Q)}, depth, key LIMIT 10")
def crux(spark, d):
    """Records reached from one, joined to their table, filtered and ranked by distance."""
    walked = graph.walk(links(spark, d, "reads", "cites"), "customer:7", 3)
    docs = records(spark, d, "documents").where(F.col("vec").isNotNull() & F.col("lang").isin("en", "fr", "de", "es")).select("key", "vec")
    ranked = walked.join(docs, "key").withColumn("exact", vectors.distance_to(F.col("vec"), _vector(spark, d, 3)))
    return ranked.orderBy("exact", "depth", "key").limit(10).select("key", "depth", F.round("exact", 6).alias("distance"))


@query(_walk_sql("customer:7", 2, "SELECT * FROM placed UNION ALL SELECT * FROM contains") + " SELECT key, depth FROM w")
def walk_out(spark, d):
    return graph.walk(links(spark, d, "placed", "contains"), "customer:7", 2)


@query(_walk_sql("region:1", 2, "SELECT * FROM isin", back=True) + " SELECT key, depth FROM w")
def walk_in(spark, d):
    return graph.walk(links(spark, d, "in"), "region:1", 2, direction="in")


@query(_walk_sql("nation:3", 3, "SELECT * FROM isin WHERE type = 'in'", both=True) + " SELECT key, depth FROM w")
def walk_both_typed(spark, d):
    return graph.walk(links(spark, d, "in", "placed"), "nation:3", 3, type_="in", direction="both")


@query(_walk_sql("documents:5", 8, "SELECT * FROM cites") + " SELECT key, depth FROM w")
def walk_deep(spark, d):
    """Past the levels of one plan: each further level is kept."""
    return graph.walk(links(spark, d, "cites"), "documents:5", 8)


@query(_walk_sql("customer:7", 2, "SELECT * FROM placed UNION ALL SELECT * FROM contains") + " SELECT '[' || string_agg('\"' || key || '\"', ',' ORDER BY depth, key) || ']' AS keys FROM w")
def walk_json(spark, d):
    return graph.walk_json(graph.walk(links(spark, d, "placed", "contains"), "customer:7", 2))


@query(f"WITH {_EDGES}, s AS (SELECT 'customer:' || c_custkey AS start FROM customer WHERE c_nationkey = 3), e AS (SELECT src, dst FROM placed UNION ALL SELECT src, dst FROM contains), a AS (SELECT DISTINCT start, dst AS key FROM s JOIN e ON src = start), b AS (SELECT DISTINCT start, dst AS key FROM a JOIN e ON src = a.key) SELECT start, key, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT *, 1 AS depth FROM a UNION ALL SELECT *, 2 FROM b) GROUP BY start, key")
def walk_many(spark, d):
    starts = records(spark, d, "customer").where("c_nationkey = 3").select(F.col("key").alias("start"))
    return graph.walk_many(links(spark, d, "placed", "contains"), starts, 2)


@query(_walk_sql("customer:7", 1, "SELECT * FROM placed") + " SELECT key, depth, o_orderstatus, o_totalprice FROM w JOIN orders ON key = 'orders:' || o_orderkey WHERE o_totalprice > 1000")
def walk_join(spark, d):
    walked = graph.walk(links(spark, d, "placed"), "customer:7", 1)
    return walked.join(records(spark, d, "orders").where("o_totalprice > 1000"), "key").select("key", "depth", "o_orderstatus", "o_totalprice")


@query(_walk_sql("customer:7", 1, "SELECT * FROM placed") + " SELECT o_orderkey FROM orders WHERE 'orders:' || o_orderkey IN (SELECT key FROM w)")
def walk_semi(spark, d):
    return records(spark, d, "orders").join(graph.walk(links(spark, d, "placed"), "customer:7", 1), "key", "left_semi").select("o_orderkey")


@query(_walk_sql("customer:7", 1, "SELECT * FROM placed") + " SELECT o_orderkey FROM orders WHERE 'orders:' || o_orderkey NOT IN (SELECT key FROM w)")
def walk_anti(spark, d):
    return records(spark, d, "orders").join(graph.walk(links(spark, d, "placed"), "customer:7", 1), "key", "left_anti").select("o_orderkey")


@query(f"WITH {_EDGES} SELECT DISTINCT src, type, dst FROM (SELECT * FROM isin UNION ALL SELECT * FROM placed) WHERE src = 'nation:3' OR dst = 'nation:3'")
def neighbours_both(spark, d):
    return graph.neighbours(links(spark, d, "in", "placed"), "nation:3", "both")


@query(f"WITH {_EDGES} SELECT src, type, dst FROM placed WHERE src = 'customer:7'")
def neighbours_typed(spark, d):
    return graph.neighbours(links(spark, d, "in", "placed"), "customer:7", "out", "placed")


# Vectors.
def _near_sql(where: str = "true", q: str = _Q, k: int = 10) -> str:
    return f"SELECT vec_id, round({_DIST.format('embedding', q)}, 6) AS distance FROM embeddings WHERE {where} ORDER BY {_DIST.format('embedding', q)}, vec_id LIMIT {k}"


def _near(spark, d, where=None, k=10, vec_id=3):
    found = vectors.nearest(table(spark, d, "embeddings"), _vector(spark, d, vec_id), k, where, key="vec_id", vec="embedding")
    return found.select(F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(_near_sql())
def nearest(spark, d):
    return _near(spark, d)


@query(_near_sql("label = 1"))
def nearest_filtered(spark, d):
    return _near(spark, d, "label = 1")


@query(_near_sql(q="(SELECT embedding FROM embeddings WHERE vec_id = 11)", k=25))
def nearest_to_record(spark, d):
    return _near(spark, d, k=25, vec_id=11)


@query(f"SELECT query, key, distance, rank FROM (SELECT a.vec_id AS query, b.vec_id AS key, round({_DIST.format('a.embedding', 'b.embedding')}, 6) AS distance, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST.format('a.embedding', 'b.embedding')}, b.vec_id) AS INTEGER) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank BETWEEN 2 AND 6")
def nearest_many(spark, d):
    """Every fiftieth vector against all; the first of each is the vector itself, whose tiny distance depends on rounding."""
    e = table(spark, d, "embeddings")
    found = vectors.nearest_many(e, e.where("vec_id % 50 = 0"), 6, key="vec_id", vec="embedding", query_key="vec_id", query_vec="embedding")
    return found.where("rank >= 2").select("query", "key", F.round("distance", 6).alias("distance"), "rank")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DIST.format('a.embedding', 'b.embedding')}, 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def distance_pairs(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(vectors.distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("SELECT label, nearest FROM (SELECT label, vec_id AS nearest, row_number() OVER (PARTITION BY label ORDER BY " + _DIST.format("embedding", _Q) + ", vec_id) AS n FROM embeddings) WHERE n = 1")
def nearest_per_group(spark, d):
    near = table(spark, d, "embeddings").withColumn("x", vectors.distance_to(F.col("embedding"), _vector(spark, d, 3)))
    first = F.row_number().over(Window.partitionBy("label").orderBy("x", "vec_id"))
    return near.withColumn("n", first).where("n = 1").select("label", F.col("vec_id").alias("nearest"))


@query("SELECT doc_id, lang FROM documents WHERE lang = (SELECT lang FROM documents WHERE doc_id = 5)")
def record_subquery(spark, d):
    docs = table(spark, d, "documents")
    one = docs.where("doc_id = 5").select(F.col("lang").alias("wanted"))
    return docs.select("doc_id", "lang").join(F.broadcast(one), F.col("lang") == F.col("wanted"), "left_semi")


# Scans and predicates.
@query("SELECT c_custkey, c_name FROM customer WHERE starts_with('customer:' || c_custkey, 'customer:1') AND 'customer:' || c_custkey > 'customer:12' ORDER BY 'customer:' || c_custkey LIMIT 100")
def scan_prefix(spark, d):
    rows = records(spark, d, "customer").where(F.col("key").startswith("customer:1") & (F.col("key") > "customer:12"))
    return rows.orderBy("key").limit(100).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey IN (1, 7, 7, 42, 1000000)")
def key_lookup_in(spark, d):
    return table(spark, d, "customer").where(F.col("c_custkey").isin(1, 7, 7, 42, 1000000)).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY 'nation:' || n_nationkey DESC LIMIT 5")
def key_desc(spark, d):
    return records(spark, d, "nation").orderBy(F.col("key").desc()).limit(5).select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND (o_orderstatus = 'F' OR NOT o_orderpriority = '1-URGENT')")
def filter_logic(spark, d):
    return table(spark, d, "orders").where((F.col("o_totalprice") > 100000) & ((F.col("o_orderstatus") == "F") | ~(F.col("o_orderpriority") == "1-URGENT"))).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 WHERE NOT (c_acctbal > 5000) OR c_acctbal IS NULL")
def filter_null_logic(spark, d):
    rich = table(spark, d, "customer").where("c_acctbal > 0")
    return table(spark, d, "orders").join(rich, F.col("o_custkey") == F.col("c_custkey"), "left").where(~(F.col("c_acctbal") > 5000) | F.col("c_acctbal").isNull()).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag NOT IN ('A', 'N')")
def filter_between_in(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 12) & ~F.col("l_returnflag").isin("A", "N")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%a_l%'")
def like_ascii_nocase(spark, d):
    return table(spark, d, "part").where(V.like(F.col("p_name"), F.lit("%A_l%"))).select("p_partkey", "p_name")


@query("SELECT doc_id, lang IS DISTINCT FROM 'en' AS other, lang IS NULL AS none FROM documents")
def is_null_safe(spark, d):
    return table(spark, d, "documents").select("doc_id", (~F.col("lang").eqNullSafe("en")).alias("other"), F.col("lang").isNull().alias("none"))


# Scalars.
@query("SELECT l_orderkey, l_linenumber, l_partkey // nullif(l_suppkey, 0) AS quotient, (-l_partkey) % nullif(l_suppkey, 0) AS rest, l_partkey // nullif(l_linenumber - 1, 0) AS guarded FROM lineitem")
def int_div_mod(spark, d):
    c = F.col
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.divide(c("l_partkey"), c("l_suppkey"), True).alias("quotient"), V.modulo(-c("l_partkey"), c("l_suppkey"), True).alias("rest"), V.divide(c("l_partkey"), c("l_linenumber") - 1, True).alias("guarded"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * 9223372036854775807.0 AS product FROM orders WHERE o_orderkey > 1 UNION ALL SELECT o_orderkey, CAST(o_orderkey * 9223372036854775807 AS DOUBLE) FROM orders WHERE o_orderkey <= 1")
def overflow_promote(spark, d):
    return table(spark, d, "orders").select("o_orderkey", V.promoted(F.col("o_orderkey"), F.lit((1 << 63) - 1), "*").alias("product"))


@query("SELECT p_partkey, p_size, coalesce(TRY_CAST(regexp_extract(p_size || p_brand, '^[+-]?[0-9]+') AS BIGINT), 0) AS n, coalesce(TRY_CAST(nullif(regexp_extract(p_brand, '^[0-9]+'), '') AS BIGINT), 0) AS none FROM part")
def cast_prefix(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", V.cast_integer(F.concat(F.col("p_size").cast("string"), "p_brand"), "text").alias("n"), V.cast_integer(F.col("p_brand"), "text").alias("none"))


@query("SELECT p_partkey, translate(p_name, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, length(p_name) AS n FROM part")
def ascii_case(spark, d):
    return table(spark, d, "part").select("p_partkey", V.ascii_upper(F.col("p_name")).alias("up"), V.ascii_lower(F.col("p_name")).alias("low"), V.length(F.col("p_name"), "text").alias("n"))


@query("SELECT p_partkey, p_name[1:2] AS a, right(p_name, 3) AS b, p_name[1:1] AS c, p_name[2:3] AS e FROM part WHERE length(p_name) >= 6")
def substr_edges(spark, d):
    x, n = F.col("p_name"), F.lit
    return table(spark, d, "part").where(F.length("p_name") >= 6).select("p_partkey", V.substr(x, n(1), n(2)).alias("a"), V.substr(x, n(-3)).alias("b"), V.substr(x, n(0), n(2)).alias("c"), V.substr(x, n(4), n(-2)).alias("e"))


@query("SELECT p_partkey, strpos(p_name, 'e') AS at, replace(p_name, 'a', '<>') AS r, trim(p_name, 'abcde') AS t, coalesce(nullif(p_size, 7), -1) AS z FROM part")
def instr_replace_trim(spark, d):
    return table(spark, d, "part").select("p_partkey", F.instr("p_name", F.lit("e")).cast("long").alias("at"), F.replace("p_name", F.lit("a"), F.lit("<>")).alias("r"), F.btrim("p_name", F.lit("abcde")).alias("t"), F.coalesce(F.nullif(F.col("p_size"), F.lit(7)), F.lit(-1)).alias("z"))


@query("SELECT p_partkey, CASE WHEN nullif(p_size, 7) IS NOT NULL THEN greatest(p_size, 20) END AS hi, CASE WHEN nullif(p_size, 7) IS NOT NULL THEN least(p_size, 20) END AS lo FROM part")
def scalar_minmax_null(spark, d):
    size = F.nullif(F.col("p_size"), F.lit(7))
    return table(spark, d, "part").select("p_partkey", V.scalar_extreme([size, F.lit(20)], True).alias("hi"), V.scalar_extreme([size, F.lit(20)], False).alias("lo"))


@query("SELECT p_partkey, CASE WHEN nullif(p_size, 7) IS NULL THEN 'null' ELSE 'integer' END AS a, 'text' AS b, 'real' AS c FROM part")
def typeof_kinds(spark, d):
    return table(spark, d, "part").select("p_partkey", V.typeof(F.nullif(F.col("p_size"), F.lit(7)), "integer").alias("a"), V.typeof(F.col("p_name"), "text").alias("b"), V.typeof(F.col("p_retailprice"), "real").alias("c"))


@query("SELECT o_orderkey, strftime(make_date(CAST(year(o_orderdate) AS BIGINT) + CAST(month(o_orderdate) // 12 AS BIGINT), CAST(month(o_orderdate) % 12 + 1 AS BIGINT), 1) + CAST(day(o_orderdate) - 1 AS INTEGER), '%Y-%m-%d') AS next, strftime(CAST(o_orderdate AS DATE) - 45, '%Y-%m-%d') AS before FROM orders")
def date_shift_overflow(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(V.shift_date(day, ["+1 month"]), "yyyy-MM-dd").alias("next"), F.date_format(V.shift_date(day, ["-45 days"]), "yyyy-MM-dd").alias("before"))


@query("SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS t FROM part")
def real_text(spark, d):
    """Reals as text by the engine's own rule."""
    return table(spark, d, "part").select("p_partkey", V.text(F.col("p_retailprice"), "real").alias("t"))


@query("SELECT p_partkey, round(p_retailprice, 0) AS whole FROM part")
def round_half_away(spark, d):
    return table(spark, d, "part").select("p_partkey", V.round_(F.col("p_retailprice")).alias("whole"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_when(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(p > 200000, "high").when(p > 100000, "mid").otherwise("low").alias("band"))


# Aggregates.
@query("SELECT count(*) AS n, count(l_quantity) AS c, round(sum(l_quantity), 2) AS s, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, max(l_linenumber) + 1 AS up FROM lineitem")
def agg_all(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count("l_quantity").alias("c"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_discount"), 6).alias("a"), F.min("l_shipdate").alias("lo"), F.max("l_extendedprice").alias("hi"), (F.max("l_linenumber") + 1).alias("up"))


@query("SELECT count(*) AS n, sum(l_quantity) AS s, coalesce(sum(l_quantity), 0.0) AS total, max(l_quantity) AS hi FROM lineitem WHERE l_quantity < 0")
def agg_empty(spark, d):
    return table(spark, d, "lineitem").where("l_quantity < 0").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.coalesce(F.sum("l_quantity"), F.lit(0.0)).alias("total"), F.max("l_quantity").alias("hi"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10")
def group_by_having(spark, d):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.count("*").alias("n")).where("n > 10")


@query("SELECT count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS statuses FROM orders")
def count_distinct(spark, d):
    return table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("statuses"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY n_regionkey")
def string_agg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("names"), F.count("*").alias("n"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY o_custkey")
def bare_column_with_max(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"))


@query("SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS keys FROM nation GROUP BY n_regionkey")
def json_group_array(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_nationkey"))).alias("keys"))


# Sorting and paging.
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def topk_offset(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20)


@query("SELECT p_partkey, nullif(p_size, 7) AS size FROM part ORDER BY size ASC NULLS FIRST, p_partkey LIMIT 50")
def sort_nulls(spark, d):
    return table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size"), F.lit(7)).alias("size")).orderBy(F.asc_nulls_first("size"), "p_partkey").limit(50)


# Joins.
@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def inner_join(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def left_join(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("m"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("m", F.lit(0).cast("long")).alias("n"))


@query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON s_suppkey = c_custkey")
def full_join(spark, d):
    s, c = table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "customer").where("c_acctbal > 0")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").where("a < b").select("a", "b")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def using_join(spark, d):
    return table(spark, d, "nation").withColumnRenamed("n_regionkey", "k").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "k"), ["k"]).select("n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_exists(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_exists(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ff_orders")
    return spark.sql("SELECT o_orderkey FROM ff_orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM ff_orders)")


# Windows.
@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w2 AS rk, dense_rank() OVER w2 AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), w2 AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
def window_rank(spark, d):
    w, w2 = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w2).alias("rk"), F.dense_rank().over(w2).alias("dr"), F.ntile(4).over(w).alias("nt"))


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_lag(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey", 2).over(w).alias("next2"), F.first_value("o_orderkey").over(w).alias("first"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS run FROM orders")
def window_frames(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.count("*").over(w.rowsBetween(-2, 1)).alias("n"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("run"))


# Sets.
@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT 'orders:' || o_orderkey AS key FROM orders EXCEPT (" + _walk_sql("customer:7", 1, "SELECT * FROM placed") + " SELECT key FROM w)")
def except_walk(spark, d):
    return records(spark, d, "orders").select("key").subtract(graph.walk(links(spark, d, "placed"), "customer:7", 1).select("key"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 12) SELECT n, count(o_orderkey) AS orders FROM r LEFT JOIN orders ON month(o_orderdate) = n GROUP BY n")
def cte_recursive(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("ff_orders")
    return spark.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 12) SELECT n, count(o_orderkey) AS orders FROM r LEFT JOIN ff_orders ON month(o_orderdate) = n GROUP BY n")


# Writes as the state they leave.
@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'VIP' ELSE c_mktsegment END AS segment, c_acctbal FROM customer UNION ALL SELECT 9000000 + s_suppkey, 'NEW', s_acctbal FROM supplier")
def upsert_merge(spark, d):
    """Given fields replace, others stay, new keys appear."""
    old = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_acctbal")
    given = old.where("c_custkey % 10 = 0").select("c_custkey", F.lit("VIP").alias("seg"), F.lit(None).cast("double").alias("bal"), F.lit(False).alias("has_bal"))
    given = given.unionAll(table(spark, d, "supplier").select(9000000 + F.col("s_suppkey"), F.lit("NEW"), "s_acctbal", F.lit(True)))
    both = old.join(given, "c_custkey", "full")
    return both.select("c_custkey", F.coalesce("seg", "segment").alias("segment"), F.when(F.col("has_bal"), F.col("bal")).otherwise(F.col("c_acctbal")).alias("c_acctbal"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey END AS a, CASE WHEN o_orderstatus = 'F' THEN o_orderkey ELSE o_custkey END AS b FROM orders")
def update_rewrite(spark, d):
    """UPDATE SET a = b, b = a WHERE ...: values come from the old row."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), (F.col("o_orderstatus") == "F").alias("hit"))
    return rows.select("o_orderkey", F.when(F.col("hit"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("hit"), F.col("a")).otherwise(F.col("b")).alias("b"))


@query("SELECT 'customer:' || o_custkey AS src, 'placed' AS type, 'orders:' || o_orderkey AS dst FROM orders WHERE o_orderstatus <> 'F'")
def delete_cascade(spark, d):
    """Links left after the finished orders are deleted."""
    gone = records(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("key").alias("dst"))
    return links(spark, d, "placed").join(gone, "dst", "left_anti").select("src", "type", "dst")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts, count(*) AS changes FROM events GROUP BY user_id")
def changelog_fold(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("changes"))


@query("SELECT (SELECT count(*) FROM customer) AS records, (SELECT count(*) FROM orders) AS links, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS lost, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS bad_vectors")
def check_report(spark, d):
    placed = links(spark, d, "placed")
    lost = placed.join(records(spark, d, "customer").select(F.col("key").alias("src")), "src", "left_anti").agg(F.count("*").alias("lost"))
    a, b = table(spark, d, "customer").agg(F.count("*").alias("records")), placed.agg(F.count("*").alias("links"))
    c = table(spark, d, "embeddings").agg(F.count_if(F.size("embedding") != 64).alias("bad_vectors"))
    one = lambda df: df.withColumn("_", F.lit(1))  # noqa: E731  each is one row
    return one(a).join(one(b), "_").join(one(lost), "_").join(one(c), "_").select("records", "links", "lost", "bad_vectors")


# Events in windows (batch forms of the streaming operators).
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return E.tumbling(table(spark, d, "events"), "1 hour").select("start", "event_type", "n", "total")


@query("WITH e AS (SELECT *, unnest([0, 1]) AS k FROM events) SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, count(*) AS n FROM e GROUP BY ALL")
def events_sliding(spark, d):
    return E.sliding(table(spark, d, "events"), "1 hour", "30 minutes").select("start", "n")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid")
def events_session(spark, d):
    return E.sessions(table(spark, d, "events"), "30 minutes").select("user_id", "start", "n")


# Functions of the pass-through tier.
@query("SELECT p_partkey FROM part WHERE p_name GLOB '*[a-e]* ?i*'")
def glob_match(spark, d):
    return table(spark, d, "part").where(X.glob(F.col("p_name"), "*[a-e]* ?i*")).select("p_partkey")


@query("SELECT p_partkey, regexp_matches(p_type, '^[A-Z]+.*MY$') AS hit FROM part")
def regexp_match(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_type").rlike("^[A-Z]+.*MY$").alias("hit"))


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def collate_nocase(spark, d):
    return table(spark, d, "customer").where(X.nocase(F.col("c_mktsegment")) == X.nocase(F.lit("Building"))).select("c_custkey")


@query("SELECT p_partkey, hex(p_name) AS h, unicode(p_name) AS u, concat_ws('-', p_brand, nullif(p_size, 7)) AS c, chr(39) || replace(p_name, chr(39), chr(39) || chr(39)) || chr(39) AS q FROM part")
def text_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.hex("p_name").alias("h"), F.ascii("p_name").alias("u"), F.concat_ws("-", "p_brand", F.nullif(F.col("p_size"), F.lit(7)).cast("string")).alias("c"), X.quote(F.col("p_name"), "text").alias("q"))


@query("SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS s, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS w, printf('%05d|%s', c_custkey, c_mktsegment) AS p FROM customer")
def sign_iif_printf(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.signum("c_acctbal").cast("int").alias("s"), F.when(F.col("c_acctbal") > 0, "in").otherwise("out").alias("w"), F.format_string("%05d|%s", "c_custkey", "c_mktsegment").alias("p"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS t, CAST(dayofweek(o_orderdate) AS VARCHAR) AS w, CAST(epoch(o_orderdate) AS BIGINT) AS e, epoch(o_orderdate) / 86400.0 + 2440587.5 AS j FROM orders")
def dates_on_fields(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", X.strftime("%Y/%m/%d %H:%M", ts).alias("t"), X.strftime("%w", ts).alias("w"), F.unix_timestamp(ts).alias("e"), X.julianday(ts).alias("j"))


@query("SELECT event_id, CAST(json_valid(props) AS BIGINT) AS ok, CAST(json_object('id', event_id, 'type', event_type) AS VARCHAR) AS o FROM events")
def json_build(spark, d):
    return table(spark, d, "events").select("event_id", X.json_valid(F.col("props")).alias("ok"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("o"))


@query("SELECT n_regionkey, CAST(i AS INTEGER) AS idx, CAST(l[i + 1] AS VARCHAR) AS value FROM (SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS l FROM nation GROUP BY ALL), unnest(range(len(l))) u(i)")
def json_each_array(spark, d):
    arrays = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_nationkey"))).alias("j"))
    return X.json_each(arrays, "j")


@query(f"SELECT vec_id, round({_DIST.format('embedding', _Q)}, 6) AS distance FROM embeddings WHERE {_DIST.format('embedding', _Q)} < 0.9")
def distance_in_sql(spark, d):
    """distance() called from SQL text."""
    X.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("ff_embeddings")
    return spark.sql("SELECT vec_id, round(distance(embedding, q), 6) AS distance FROM ff_embeddings JOIN (SELECT embedding AS q FROM ff_embeddings WHERE vec_id = 3) ON distance(embedding, q) < 0.9")
