"""The link graph: neighbours and walks over an edge table (src, type, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidError
from ..sources.files import scratch

MAX_DEPTH = 32
#: Keys of a frontier that go into the scan of the edges as a filter; rows of one that are broadcast.
PRUNE_KEYS, BROADCAST_ROWS = 500, 200_000
DIRECTIONS = ("out", "in", "both")


def direction_of(text: str | None) -> str:
    value = (text or "out").lower()
    if value not in DIRECTIONS:
        raise InvalidError(f"a direction is one of {', '.join(DIRECTIONS)}")
    return value


def oriented(links: DataFrame, direction: str | None = "out", type_: str | None = None, reverse: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) to follow from a to b. ``reverse`` holds the same links in the order of dst."""
    rows, back = (x if not type_ else x.where(F.col("type") == type_) for x in (links, links if reverse is None else reverse))
    out, into = rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), back.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"out": lambda: out, "in": lambda: into, "both": lambda: out.unionAll(into)}[direction_of(direction)]()


def neighbours(links: DataFrame, key: str, direction: str | None = "out", type_: str | None = None, reverse: DataFrame | None = None) -> DataFrame:
    """Links (src, type, dst) at one record, ordered; a link to itself comes once."""
    rows, back = (x if not type_ else x.where(F.col("type") == type_) for x in (links, links if reverse is None else reverse))
    out, into = rows.where(F.col("src") == key), back.where(F.col("dst") == key)
    way = direction_of(direction)
    if way == "both":
        return out.unionByName(into).select("src", "type", "dst").distinct().orderBy("type", "src", "dst")
    return (out if way == "out" else into).select("src", "type", "dst").distinct().orderBy("type", "dst" if way == "out" else "src")


def walk_many(links: DataFrame, starts: DataFrame, depth: int, type_: str | None = None, direction: str | None = "out", reverse: DataFrame | None = None) -> DataFrame:
    """(start, key, depth) of every record reached from each start in 1 to ``depth`` steps, at its least depth; the start itself is left out.

    Each level joins the frontier with the edges once and drops what was seen; the walk ends when a frontier is empty. A frontier is kept and
    counted before it is used: the keys of a small one filter the scan of the edges, a larger one is broadcast, a large one is shuffled.
    """
    if not 1 <= depth <= MAX_DEPTH:
        raise InvalidError(f"a walk's depth is from 1 to {MAX_DEPTH}")
    scratch(links.sparkSession)
    edges = oriented(links, direction, type_, reverse)
    frontier = starts.select("start", F.col("start").alias("key"), F.lit(0).alias("depth")).distinct()
    levels, rows = [], 0
    for level in range(1, depth + 1):
        frontier = frontier.checkpoint()
        count = frontier.count()
        rows += count
        if not count:
            break
        levels.append(frontier)
        here, at = edges, frontier.select("start", F.col("key").alias("a"))
        if count <= PRUNE_KEYS:
            here = edges.where(F.col("a").isin([r.a for r in at.select("a").distinct().collect()]))
        seen = _union(levels).select("start", "key")
        reached = here.join(F.broadcast(at) if count <= BROADCAST_ROWS else at, "a").select("start", F.col("b").alias("key")).distinct()
        frontier = reached.join(F.broadcast(seen) if rows <= BROADCAST_ROWS else seen, ["start", "key"], "left_anti").withColumn("depth", F.lit(level))
    else:
        levels.append(frontier)
    return _union(levels).where("depth > 0") if levels else frontier


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def walk(links: DataFrame, start: str, depth: int, type_: str | None = None, direction: str | None = "out", reverse: DataFrame | None = None) -> DataFrame:
    """(key, depth) reached from one start; order by depth and key to list them as a walk does."""
    one = links.sparkSession.createDataFrame([(start,)], "start string")
    return walk_many(links, one, depth, type_, direction, reverse).select("key", "depth")


def walk_json(walked: DataFrame) -> DataFrame:
    """One row: the keys in walk order as a JSON array, with <, > and & written as escapes."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("depth", "key"))), lambda x: x["key"])
    text: Column = F.to_json(keys)
    for sign, escape in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        text = F.replace(text, F.lit(sign), F.lit(escape))
    return walked.agg(text.alias("keys"))
