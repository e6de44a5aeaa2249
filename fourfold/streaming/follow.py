"""Following change lists as streams: the fold of a stream of changes, and a follower of a database's commits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.database import Database


def change_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Change events that other jobs write as Parquet files under ``folder``; only whole files are seen."""
    return spark.readStream.schema(schema).parquet(folder)


def latest_per_key(changes: DataFrame, key: str, order: str, *, late: str | None = None, ts: str | None = None) -> DataFrame:
    """The last change of each key: an aggregation that serves streams (complete or update mode) and batch alike."""
    df = changes.withWatermark(ts, late) if late and ts else changes
    rest = [c for c in changes.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


class Follower:
    """Calls ``apply(table, changes)`` for each delta of each commit after ``version``, in order and once."""

    def __init__(self, db: Database, version: int = 0):
        self.db, self.version = db, version

    def poll(self, apply: Callable[[str, DataFrame], None]) -> int:
        """Work through the commits made since the last call; the number of them. After a compaction the state is given anew, as one change."""
        seen = 0
        versions = [v for v in self.db._versions() if v > self.version]
        kept = set(self.db._versions())
        for v in versions:
            now = self.db.manifest(v)
            old = self.db.manifest(v - 1) if v - 1 in kept else None
            for name, info in [*now.tables.items(), ("links", now.links)]:
                was = (old.links if name == "links" else old.tables.get(name)) if old else None
                if was is not None and was.base == info.base:
                    fresh = [d for d in info.deltas if d not in was.deltas]
                else:
                    fresh = [*([info.base] if info.base else []), *info.deltas]
                for d in fresh:
                    apply(name, self.db.spark.read.parquet(d))
            self.version, seen = v, seen + 1
        return seen
