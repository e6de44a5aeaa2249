"""The Parquet tables seen as one set of records: keyed tables, vectors and typed links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Each record table's key column.
KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "region": "r_regionkey", "documents": "doc_id"}


def key_of(name: str, ident: Column | str) -> Column:
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.concat(F.lit(f"{name}:"), ident.cast("string"))


def records(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its ``key``; documents have the vector of the embedding with their number, if there is one."""
    df = table(spark, sf_dir, name).withColumn("key", key_of(name, KEYS[name]))
    if name == "documents":
        vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
        df = df.join(vecs, "doc_id", "left")
    return df


def links(spark: SparkSession, sf_dir: str, *types: str) -> DataFrame:
    """Links (src, type, dst) from foreign keys, and two made by rule so that walks reach documents; only the named types are read. A link comes
    as often as its foreign keys do; walks and neighbours make it one."""
    t = lambda name: table(spark, sf_dir, name)
    n_docs = lambda: t("documents").count()

    def edge(df: DataFrame, src: Column, name: str, dst: Column) -> DataFrame:
        return df.select(src.alias("src"), F.lit(name).alias("type"), dst.alias("dst"))

    make = {
        "placed": lambda: edge(t("orders"), key_of("customer", "o_custkey"), "placed", key_of("orders", "o_orderkey")),
        "contains": lambda: edge(t("lineitem"), key_of("orders", "l_orderkey"), "contains", key_of("part", "l_partkey")),
        "suppliedby": lambda: edge(t("lineitem"), key_of("part", "l_partkey"), "suppliedby", key_of("supplier", "l_suppkey")),
        "in": lambda: edge(t("customer"), key_of("customer", "c_custkey"), "in", key_of("nation", "c_nationkey")).unionAll(edge(t("nation"), key_of("nation", "n_nationkey"), "in", key_of("region", "n_regionkey"))),
        "reads": lambda: edge(t("customer"), key_of("customer", "c_custkey"), "reads", key_of("documents", F.col("c_custkey") % n_docs())),
        "cites": lambda: edge(t("documents"), key_of("documents", "doc_id"), "cites", key_of("documents", (F.col("doc_id") * 7 + 1) % n_docs())),
    }
    out = None
    for name in types or tuple(make):
        out = make[name]() if out is None else out.unionAll(make[name]())
    return out
