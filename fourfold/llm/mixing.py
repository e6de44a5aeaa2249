"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Each source gets a share of all words by weight, at most ``repeats`` times what it has; what a capped source
leaves is shared among the others by weight. Sources whose targets are alike (within a factor of two) make a class with blocks of one length, so
that a source has some ``FINENESS`` blocks in its target or more, down to blocks of one word; a class has as many slots as blocks in its targets.
Slot t of N takes the golden-ratio point t s / N modulo 1, where s is N / phi made coprime to N (so that the N points are spread evenly and each
stretch gets its number of them, to one), and goes to the source whose stretch of cumulative targets holds it: any run of slots has nearly the
right proportions. Within a source, documents are shuffled by hash and their words cut into blocks; the r-th slot of the source takes
block r, modulo their number.

Scale: one narrow table (id, source, size, hashes) is kept; ranks and running sums go in two levels (hash bucket, slot chunk or run of sources, then
within it), so a source with a third of all rows is spread over many tasks, and sources may be as many as hosts. The source table is
broadcast only after counting it. Slots are as many as documents' blocks, at most ``2 * FINENESS`` for a small source.
Points are exact integers, so their number does not blur them.

Defined results: a null text has size 0; the null source is a source of its own, ordered last; documents of size 0
are taken 0 times; repeated rows are separate documents, alike where all they have is alike; other columns are not read. No documents: no rows.
"""

from __future__ import annotations

from decimal import Decimal
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .sharding import key_hash

WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block at most (a power of two), and blocks that a target should span.
BLOCK, FINENESS = 1024, 256
#: Sources are broadcast up to so many rows.
BROADCAST_SOURCES = 100_000
PHI = 0.6180339887498949
_CELLS, _BUCKET_BITS, _CHUNK, _RUN = 1024, 12, 1 << 14, 1 << 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def _numbered(table: DataFrame) -> DataFrame:
    """``table`` with sid, the place of its source by code point, null last, from 1: sorted by range, then places within ranges and their sums."""
    order = F.col("source").asc_nulls_last()
    placed = cut(table.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).count()  # one row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(parts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    placed = placed.withColumn("part", F.shiftright("at", 33)).join(base, "part")
    return placed.withColumn("sid", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "part", "base")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: sid (1-based, by code point, null last), source, source_size, weight, target, block.

    The common level (words for each unit of weight) rises as sources are found to be capped below it, until none is new.
    """
    table = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = table.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
    table = cut(table.withColumn("ratio", repeats * F.col("source_size") / F.col("weight")))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, known = 0.0, -1
    while True:
        capped = F.col("ratio") < level
        n, used, open_ = table.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, repeats * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == known or not open_:
            break
        level, known = float(total - used) / float(open_), n
    target = F.least(F.col("weight") * F.lit(level), (repeats * F.col("source_size")).cast("double"))
    block = F.lit(1).cast("long")
    for k in range(1, BLOCK.bit_length()):
        block = F.when(F.col("target") >= float(FINENESS << k), F.lit(1 << k)).otherwise(block)
    return table.select("sid", "source", "source_size", "weight", target.alias("target")).withColumn("block", block.cast("long"))


def lattice(points: int) -> int:
    """A step through 0 .. points - 1 that meets each once and is near the golden ratio of them."""
    step = max(1, int(points * PHI))
    while gcd(step, points) > 1:
        step += 1
    return step


def schedule(spark, sources: DataFrame) -> DataFrame:
    """Rows (sid, rank): the slots of each source, numbered from 0 in their order."""
    share = sources.select("sid", "block", F.round("target").cast("long").alias("share")).where("share > 0")
    stretch = share.withColumn("run", F.floor(F.col("sid") / _RUN))
    upto = Window.partitionBy("block").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    base = stretch.groupBy("block", "run").agg(F.sum("share").alias("n")).select("block", "run", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block", "run").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    stretch = stretch.withColumn("in", F.sum("share").over(inside)).join(base, ["block", "run"]).withColumn("hi", F.col("base") + F.col("in")).withColumn("lo", F.col("hi") - F.col("share"))
    classes = sorted(map(tuple, share.groupBy("block").agg(F.sum("share"), F.count("*")).collect()))  # a row for each power of two up to BLOCK
    if not classes:
        return spark.createDataFrame([], "sid long, rank long")
    slots = [max(1, (total + block // 2) // block) for block, total, _ in classes]
    first = [sum(slots[:i]) for i in range(len(slots))]
    width = [-(-total // max(_CELLS, 4 * n)) for _, total, n in classes]
    pick = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("class"))
    big = "decimal(20,0)"
    t = spark.range(sum(slots)).withColumn("class", sum((F.col("id") >= f).cast("int") for f in first))
    t = t.select(pick([b for b, _, _ in classes], "long").alias("block"), (F.col("id") - pick(first, "long")).alias("t"), pick(slots, big).alias("n"), pick([lattice(n) for n in slots], big).alias("s"), pick([x for _, x, _ in classes], big).alias("total"), pick(width, "long").alias("width"))
    half = F.lit(Decimal(2))
    t = t.withColumn("x", ((F.col("t").cast(big) * F.col("s")) % F.col("n")).cast(big)).withColumn("half", (F.col("total") - F.col("total") % half) / half)
    t = t.select("block", "t", F.expr("(x * total + CAST(half AS DECIMAL(20,0))) div n").alias("at"), "width").withColumn("cell", F.expr("at div width"))
    widths = F.create_map(*(F.lit(x) for (block, _, _), w in zip(classes, width) for x in (block, w)))
    stretch = stretch.withColumn("width", widths[F.col("block").cast("int")].cast("long"))
    stretch = stretch.select("sid", F.col("block").alias("of"), "lo", "hi", F.explode(F.expr("sequence(lo div width, (hi - 1) div width)")).alias("in_cell"))
    stretch = _small(stretch, sum(n for _, _, n in classes))
    hit = t.join(stretch, (F.col("block") == F.col("of")) & (F.col("cell") == F.col("in_cell")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).select("t", "sid", F.floor(F.col("t") / _CHUNK).alias("chunk"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = hit.groupBy("sid", "chunk").count().select("sid", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = hit.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("t")))
    return ranked.join(base, ["sid", "chunk"]).select("sid", (F.col("base") + F.col("nth") - 1).alias("rank"))


def blocks(sizes: DataFrame) -> DataFrame:
    """Rows (rid, nth, words): the stretch of each document that lies in each block of its shuffled source."""
    bucketed = sizes.withColumn("bucket", F.shiftright("h", 60 - _BUCKET_BITS))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = bucketed.groupBy("sid", "bucket").agg(F.sum("size").alias("n")).select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "tie", "rid").rowsBetween(Window.unboundedPreceding, 0)
    laid = bucketed.withColumn("end", F.sum("size").over(inside)).join(base, ["sid", "bucket"])
    laid = laid.withColumn("end", F.col("base") + F.col("end")).withColumn("start", F.col("end") - F.col("size"))
    cutup = laid.withColumn("nth", F.explode_outer(F.when(F.col("size") > 0, F.expr("sequence(start div block, (end - 1) div block)"))))
    words = F.least("end", (F.col("nth") + 1) * F.col("block")) - F.greatest("start", F.col("nth") * F.col("block"))
    return cutup.withColumn("words", F.coalesce(words, F.lit(0)))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per document row: rid, doc_id, text_hash, size, source_size, target, taken."""
    spark = docs.sparkSession
    tie = F.md5(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    sizes = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key_hash(F.col(doc_id)).alias("h"), F.conv(F.substring(tie, 1, 15), 16, 10).cast("long").alias("tie")))
    sources = cut(source_targets(sizes, weights, repeats))
    count = sources.count()
    known = sources.select(F.col("source").alias("source_"), "sid", "source_size", "target", "block")
    sizes = sizes.join(_small(known, count), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "source")
    lengths = sources.where("source_size > 0").select("sid", F.ceil(F.col("source_size") / F.col("block")).alias("blocks"))
    turns = schedule(spark, sources).join(_small(lengths, count), "sid").where(F.col("rank") < repeats * F.col("blocks"))
    turns = turns.groupBy("sid", (F.col("rank") % F.col("blocks")).alias("nth")).agg(F.count("*").alias("times"))
    taken = blocks(sizes).join(turns, ["sid", "nth"], "left")
    return taken.groupBy("rid", "doc_id", "text_hash", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
