"""The corpus pipeline: languages told, near-duplicates and leaked benchmark text dropped, sources mixed, rows sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of ``documents``. Decisions reach the texts by anti-joins on (id, hash of the text); the lists of
decisions are counted, and broadcast only while they are small.

Defined results, for every stage: other columns of ``docs`` are carried as they are, whatever their names; an empty table stays empty with its
columns; whole texts count, however long. Language ID lets a null text, one without letters and one below ``LEAST_SCORE`` go; rows that are repeated stay.
Near-dedup keeps the row with the least id of a group (the least MD5 where a group has no id), one of rows that are equal in id and text; a null
text is no group's. Decontamination treats rows with one id and text alike. The mixture takes a row of no words 0 times; of rows with one id and text
each has its own turns. The shard of a null id is that of the text "null".
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm import decontaminate, langid, mixing, neardedup, sharding
from fourfold.llm.common import alnum_words, cut, fresh
from fourfold.sources.files import Files, scratch

#: Rows of decisions (id and hash) that may be broadcast.
BROADCAST_ROWS = 400_000
LEAST_SCORE = 0.4


def _keyed(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``keys`` (doc, text_hash and what else it has) by id and text, null-safe."""
    doc, hash_ = fresh(docs, "_doc", "_hash")
    keys = keys.withColumnRenamed("doc", doc).withColumnRenamed("text_hash", hash_)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    on = docs["doc_id"].eqNullSafe(keys[doc]) & F.xxhash64(docs["text"]).eqNullSafe(keys[hash_])
    return docs.join(keys, on, how).drop(doc, hash_) if how == "inner" else docs.join(keys, on, how)


def _once(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` with rows whose (doc, text_hash) is in ``repeated`` kept once."""
    if repeated.isEmpty():
        return docs
    key = fresh(docs, "_key")[0]
    twins = _keyed(docs, repeated, "left_semi").withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)
    return _keyed(docs, repeated, "left_anti").unionByName(twins)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field tells; what has no letters, or no clear language, goes."""
    return langid.keep_identified(docs, langid.learn(docs), least=LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id."""
    hashed = F.xxhash64("text").alias("text_hash")
    found = cut(neardedup.near_duplicates(docs))
    head = F.col("doc_id").eqNullSafe(F.col("group_id")) & F.col("node").eqNullSafe(F.col("group_node"))
    keys = docs.select(F.col("doc_id").alias("doc"), F.unhex(F.md5("text")).alias("node"), hashed)
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def hashes(rows: DataFrame) -> DataFrame:
        rows = cut(rows.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n")).distinct())
        return cut(keys.join(small(rows), keys["doc"].eqNullSafe(F.col("_d")) & (keys["node"] == F.col("_n")), "left_semi").select("doc", "text_hash").distinct())

    kept = _keyed(docs, hashes(found.where(~head)), "left_anti")
    return _once(kept, hashes(found.where(head & F.col("node").isNotNull()).groupBy("doc_id", "node").count().where("count > 1")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no whole window with a benchmark item and nothing with two items; all others go. Items shorter than a window
    count as items only; the ids of items are marked by kind (w: a window or more, s: shorter)."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    kind = F.when(F.size(alnum_words(F.col("text"))) >= decontaminate.SPAN, F.lit("w")).otherwise(F.lit("s"))
    bench = bench.select(F.concat(kind, F.coalesce(F.col("item_id").cast("string"), F.lit(""))).alias("item_id"), "text")
    found = decontaminate.decontaminate(docs, bench)
    leaks = F.exists("items", lambda x: x.startswith("w")) | (F.size(F.array_distinct(F.transform("items", lambda x: F.substring(x, 2, 1 << 30)))) >= 2)
    return _keyed(docs, cut(found.where(leaks).select("doc", "text_hash").distinct()), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (words taken over its size, rounded), at most three times."""
    taken = mixing.mix(docs)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    times = cut(taken.groupBy(F.col("doc_id").alias("doc"), "text_hash").agg(F.sum(times).cast("int").alias("_times"), F.count("*").alias("_rows")))
    once = _once(docs, times.where("_rows > 1").select("doc", "text_hash"))
    repeated = _keyed(once, times.where("_times > 0").select("doc", "text_hash", "_times"), "inner")
    return repeated.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each goes to."""
    return sharding.assign_shards(docs, "doc_id")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("shard", shard)]
#: A trained field and signatures are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. What a stage leaves is kept in the shared folder until the next has ended; the last one's stays,
    since the result is read from it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    files, before = Files(spark, at), None
    for i, (name, stage) in enumerate(STAGES):
        here = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        docs = spark.read.parquet(here)
        if before:
            files.delete(before)
        before = here
    return docs
