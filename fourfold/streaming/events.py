"""Windows over event tables and streams: the same functions serve batch and Structured Streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stamped(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    """Times as timestamps (streams need them for watermarks), with a watermark if ``late`` is given."""
    df = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if late else df


def tumbling(events: DataFrame, size: str, *, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Counts and sums per window and type."""
    rows = _stamped(events, ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, *, ts: str = "ts", late: str | None = None) -> DataFrame:
    rows = _stamped(events, ts, late).groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str, *, ts: str = "ts", user: str = "user_id", late: str | None = None) -> DataFrame:
    """One row per run of a user's events less than ``gap`` apart."""
    rows = _stamped(events, ts, late).groupBy(F.session_window(ts, gap).alias("window"), user).agg(F.count("*").alias("n"))
    return rows.select(user, F.col("window.start").cast("timestamp_ntz").alias("start"), "n")
