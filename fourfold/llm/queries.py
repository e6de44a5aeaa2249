"""The opN_<name> queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import fingerprint as _fingerprint
from . import htmltext as _htmltext
from . import langid as _langid
from . import licenses as _licenses
from . import mixing as _mixing
from . import neardedup as _neardedup
from . import sharding as _sharding
from . import substrings as _substrings
from . import warc as _warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _langid.predict(docs, _langid.learn(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bp AS (SELECT item, w, least(len(w), 8) AS k, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS p FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM bp),
ks AS (SELECT DISTINCT k FROM bw),
dp AS (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k),
dw AS (SELECT rid, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM dp),
h AS (SELECT rid, p, dw.k, item FROM dw JOIN bw USING (k, g)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _htmltext.extract(_read(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


_BLOCK = "CASE " + " ".join(f"WHEN target >= {_mixing.FINENESS << k} THEN {1 << k}" for k in range(_mixing.BLOCK.bit_length() - 1, 0, -1)) + " ELSE 1 END"
OP4_SQL = f"""
WITH z AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h,
         CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS tie
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, [5, 2, 1][(sid - 1) % 3 + 1] AS weight FROM s1),
s3 AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio, (SELECT sum(source_size) FROM s0) AS everything FROM s2),
s4 AS (SELECT *, CAST(everything - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM s3),
lv AS (SELECT level FROM s4 WHERE level <= ratio ORDER BY ratio, sid LIMIT 1),
s5 AS (SELECT sid, source, source_size, least(weight * (SELECT level FROM lv), CAST(3 * source_size AS DOUBLE)) AS target FROM s4),
src AS (SELECT *, CAST({_BLOCK} AS BIGINT) AS block FROM s5),
st AS (SELECT sid, block, CAST(sum(CAST(round(target) AS BIGINT)) OVER (PARTITION BY block ORDER BY sid) AS BIGINT) AS hi, CAST(round(target) AS BIGINT) AS share FROM src WHERE round(target) > 0),
c0 AS (SELECT block, CAST(sum(share) AS BIGINT) AS total, CAST(greatest(1, (sum(share) + block // 2) // block) AS BIGINT) AS n FROM st GROUP BY block),
c1 AS (SELECT *, CAST(greatest(1, floor(n * {_mixing.PHI}::DOUBLE)) AS BIGINT) AS near FROM c0),
c2 AS (SELECT block, total, n, min(k) AS s FROM (SELECT *, unnest(range(near, near + 2000)) AS k FROM c1) WHERE gcd(k, n) = 1 GROUP BY ALL),
pt AS (SELECT *, unnest(range(n)) AS t FROM c2),
au AS (SELECT block, t, CAST(((CAST(t AS HUGEINT) * s % n) * total + total // 2) // n AS BIGINT) AS a FROM pt),
sl AS (SELECT t, sid FROM au JOIN st ON au.block = st.block AND a >= st.hi - st.share AND a < st.hi),
rk AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS rank FROM sl),
nb AS (SELECT sid, CAST(ceil(source_size / CAST(block AS DOUBLE)) AS BIGINT) AS blocks FROM src WHERE source_size > 0),
tn AS (SELECT sid, rank % blocks AS nth, count(*) AS times FROM rk JOIN nb USING (sid) WHERE rank < 3 * blocks GROUP BY ALL),
ld AS (SELECT z.*, sid, source_size, target, block AS b, sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size, tie, rid ROWS UNBOUNDED PRECEDING) AS e
       FROM z JOIN src ON z.source IS NOT DISTINCT FROM src.source),
pc AS (SELECT rid, sid, e - size AS s, e, b, unnest(range(CAST((e - size) // b AS BIGINT), CAST((e - 1) // b AS BIGINT) + 1)) AS nth FROM ld WHERE size > 0),
tk AS (SELECT rid, sum((least(e, (pc.nth + 1) * b) - greatest(s, pc.nth * b)) * times) AS taken FROM pc JOIN tn USING (sid, nth) GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM ld LEFT JOIN tk USING (rid)
"""


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprint.fingerprint_chain(_read(spark, sf_dir, "documents"))


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.assign_shards(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


OP6_SQL = """
WITH RECURSIVE p AS (
  SELECT s, CAST('0x' || substr(md5('shard-' || s || '/offset'), 1, 15) AS BIGINT) % 4093 AS o,
         CAST('0x' || substr(md5('shard-' || s || '/skip'), 1, 15) AS BIGINT) % 4092 + 1 AS k
  FROM range(32) r(s)),
pl AS (SELECT list(o ORDER BY s) AS os, list(k ORDER BY s) AS ks FROM p),
fill AS (
  SELECT 0 AS t, list_transform(range(4093), lambda x: CAST(-1 AS INTEGER)) AS owner
  UNION ALL
  SELECT t + 1, owner[1:c] || [CAST(t % 32 AS INTEGER)] || owner[c + 2:]
  FROM (SELECT t, owner, (os[t % 32 + 1] + ks[t % 32 + 1] * list_filter(range(4093), lambda j: owner[(os[t % 32 + 1] + ks[t % 32 + 1] * j) % 4093 + 1] < 0)[1]) % 4093 AS c
        FROM fill, pl WHERE t < 4093)),
done AS (SELECT owner FROM fill WHERE t = 4093),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) % 4093 AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, owner[slot + 1] AS shard FROM d, done
"""


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _neardedup.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "group_id", (F.col("doc_id").eqNullSafe(F.col("group_id"))).alias("representative"))


#: Every pair of unlike texts that share a shingle, by exact multiset Jaccard; groups by the least reachable node.
OP7_SQL = r"""
WITH RECURSIVE r AS (SELECT row_number() OVER () AS rid, doc_id, text, md5(text) AS node FROM documents),
t AS (SELECT node, regexp_extract_all(translate(any_value(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM r WHERE node IS NOT NULL GROUP BY node),
p AS (SELECT node, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT node, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
m AS (SELECT node, g, count(*) AS c FROM p GROUP BY ALL),
n AS (SELECT node, sum(c) AS n FROM m GROUP BY node),
s AS (SELECT a.node AS a, b.node AS b, sum(least(a.c, b.c)) AS sh FROM m a JOIN m b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
e AS (SELECT a, b FROM s JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE sh >= 0.8 * (x.n + y.n - sh) - 1e-9),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
q AS (SELECT node AS a, node AS b FROM t UNION SELECT q.a, u.b FROM q JOIN u ON u.a = q.b),
l AS (SELECT a AS node, min(b) AS label FROM q GROUP BY a),
h AS (SELECT label, min(doc_id) AS head FROM r JOIN l USING (node) GROUP BY label)
SELECT doc_id, CASE WHEN r.node IS NULL THEN doc_id ELSE head END AS group_id, doc_id IS NOT DISTINCT FROM CASE WHEN r.node IS NULL THEN doc_id ELSE head END AS representative
FROM r LEFT JOIN l ON l.node = r.node LEFT JOIN h ON h.label = l.label
"""


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _warc.round_trip(spark, _read(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.top IS NOT NULL AND page_id IS DISTINCT FROM f.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.top IS NOT NULL AND page_id IS DISTINCT FROM f.top THEN f.top END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 1000
"""


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substrings.remove_repeats(_read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50),
g AS (SELECT rid, doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) AS q FROM g JOIN f USING (g) WHERE doc_id > first),
r AS (SELECT rid, list(q) AS qs FROM c GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (rid)
"""

def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _licenses.scan(_read(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_max("matches.containment").alias("containment"),
    )


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_VALUES = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(_licenses.TEMPLATES))
OP10_SQL = f"""
WITH t AS (SELECT tid, license, {_SPLIT} AS w FROM (VALUES {_VALUES}) v(tid, license, text)),
ts AS (SELECT tid, license, len(w) AS length, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS p FROM t)),
tn AS (SELECT tid, count(DISTINCT g) AS n, max(length) - 4 AS s, greatest(2, max(length) // 4) AS slack FROM ts GROUP BY tid),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_SPLIT} AS w FROM documents),
ds AS (SELECT rid, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS p FROM d)),
m AS (SELECT rid, tid, license, ds.p, ds.p - ts.p AS shift, g FROM ds JOIN ts USING (g)),
a AS (SELECT DISTINCT rid, tid, license, shift FROM m),
c AS (SELECT a.rid, a.tid, a.license, a.shift, count(DISTINCT m.g) / CAST(any_value(n) AS DOUBLE) AS c
      FROM a JOIN tn USING (tid) JOIN m ON m.rid = a.rid AND m.tid = a.tid AND m.p BETWEEN a.shift + 1 - slack AND a.shift + s + slack GROUP BY ALL),
b AS (SELECT rid, tid, license, max(c) AS c FROM c WHERE c >= 0.8 - 1e-12 GROUP BY ALL),
r AS (SELECT rid, count(*) AS n_matches, array_to_string(list_sort(list_distinct(list(license))), ',') AS licenses, max(c) AS containment FROM b GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches, coalesce(licenses, '') AS licenses, containment
FROM d LEFT JOIN r USING (rid)
"""

QUERIES = {"op1_langid": op1_langid, "op2_decontaminate": op2_decontaminate, "op3_main_text": op3_main_text, "op4_mix": op4_mix, "op5_fingerprint": op5_fingerprint, "op6_shard": op6_shard, "op7_near_dedup": op7_near_dedup, "op8_warc": op8_warc, "op9_remove_repeats": op9_remove_repeats, "op10_licenses": op10_licenses}
ORACLES = {"op2_decontaminate": OP2_SQL, "op4_mix": OP4_SQL, "op6_shard": OP6_SQL, "op7_near_dedup": OP7_SQL, "op8_warc": OP8_SQL, "op9_remove_repeats": OP9_SQL, "op10_licenses": OP10_SQL}
