"""Benchmark decontamination by winnowing, in DataFrame operations alone.

Every document and benchmark item is reduced to its winnowed k-grams: of each ``window`` consecutive
k-gram hashes the smallest is kept (the leftmost where equal). A span of k + window - 1 shared words
therefore shares a kept k-gram at the same place on both sides. The kept hashes are joined, hash and place alone; what is met
is gathered by document and joined back to its text, where each hit is extended left and right, word by word, so that the 33 bits of
hash that the join uses decide nothing. Words are hashed once; hashes of k-grams and least hashes of windows come by doubling. No
text is shuffled unless what is met is too much to broadcast, and no row stands for a whole document in a join by hash.

Defined results: null texts have no words; an item with no word is ignored; items shorter than the
span are matched whole, by grams of their own length; a null item id reads as the empty string; equal
item ids are one item; repeated document rows (also with null ids) each get their own row; columns of the
input other than the id and text are neither read nor returned. An empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_WORD, alnum_words, cut, lesser, let, mixed, spread

#: Words of a window, and of a k-gram; SPAN - GRAM + 1 hashes are winnowed together.
SPAN, GRAM = 8, 4
#: The benchmark's fingerprints, and what is met, are broadcast up to so many bytes, measured; beyond it both sides shuffle.
BROADCAST_BYTES = 32 << 20
#: Positions take the low bits of a fingerprint (a Spark array has fewer than 2^31 entries).
_POS = (1 << 31) - 1
_MARKS = "array<struct<gram:int,hash:bigint,pos:int>>"


def _kept(words: Column, gram: int, window: int, then: Callable[[Column], Column]) -> Column:
    """``then`` over an array of longs: hash in the high 33 bits, 1-based position in the low 31, of each kept gram. Words are hashed once."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    placed = lambda g: F.transform(g, lambda x, i: x.bitwiseAND(F.lit(~_POS)).bitwiseOR((i + 1).cast("long")))
    return spread(hashes, gram, mixed, lambda g: spread(placed(g), window, lesser, lambda m: then(F.array_distinct(m) if window > 1 else m)))


def _marks(words: Column, gram: int, window: int, applies: Column | None = None) -> Column:
    """Array of structs (gram, hash, pos) of the kept grams, empty unless ``applies``."""
    made = _kept(words, gram, window, lambda kept: F.transform(kept, lambda v: F.struct(F.lit(gram).alias("gram"), F.shiftright(v, 31).alias("hash"), v.bitwiseAND(F.lit(_POS)).cast("int").alias("pos"))))
    fits = F.size(words) >= gram + window - 1
    return F.when(fits if applies is None else fits & applies, made.cast(_MARKS)).otherwise(F.array().cast(_MARKS))


def _around(words: Column, gram: int, side: int, pos: Column) -> Column:
    """The gram at ``pos`` with ``side`` words on either side, null beyond the ends."""
    return F.transform(F.sequence(pos - (side + 1), pos + (gram + side - 2)), lambda j: F.get(words, j))


def _extent(words: Column, at: Column, other: Column, start: int, step: int, room: int) -> Column:
    """How many words agree, those from index ``at`` on and those of ``other`` from ``start`` on, going by ``step``, up to ``room``."""
    out = F.lit(0)
    for n in reversed(range(room)):
        out = F.when(F.get(words, at + n * step) == F.get(other, F.lit(start + n * step)), out + 1).otherwise(0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text", span: int = SPAN, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document row: doc, text_hash (tells rows of one id apart), n_words, n_hit, items (sorted ids)."""
    window, side = span - gram + 1, span - gram
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), alnum_words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    short = sorted(r[0] for r in items.where(F.size("w") < span).select(F.size("w")).distinct().collect())  # at most span - 1 numbers
    docs = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    w, mark = F.col("w"), F.col("m")
    ours = items.select("item", "w", F.explode(F.concat(_marks(w, gram, window), *(_marks(w, n, 1, F.size(w) == n) for n in short))).alias("m"))
    theirs = F.when(F.size(w) >= span, _around(w, gram, side, mark["pos"])).otherwise(w)
    ours = ours.select("item", mark["gram"].alias("gram"), mark["hash"].alias("hash"), theirs.alias("theirs"))
    ours = cut(ours.groupBy("gram", "hash", "theirs").agg(F.collect_set("item").alias("items")))
    held = ours.agg(F.sum(F.length(F.concat_ws(" ", "theirs")) + F.length(F.concat_ws(" ", "items")) + 200)).first()[0] or 0

    marks = docs.where("text IS NOT NULL").select("doc", "text_hash", F.explode(let(alnum_words(F.col("text")), lambda w: F.concat(_marks(w, gram, window), *(_marks(w, n, 1) for n in short)))).alias("m"))
    marks = marks.select("doc", "text_hash", "m.*")
    met = marks.join(F.broadcast(ours) if held <= broadcast_bytes else ours, ["gram", "hash"])
    met = cut(met.groupBy("doc", "text_hash").agg(F.collect_set(F.struct("gram", "pos", "theirs", F.array_sort("items").alias("items"))).alias("met")))
    weight = met.agg(F.sum(100 + F.aggregate("met", F.lit(0), lambda n, x: n + 40 + 12 * (F.size(x["theirs"]) + F.size(x["items"]))))).first()[0] or 0
    met = met.withColumnsRenamed({"doc": "doc_", "text_hash": "hash_"})
    both = docs.join(F.broadcast(met) if weight <= broadcast_bytes else met, (docs["text_hash"] == met["hash_"]) & docs["doc"].eqNullSafe(met["doc_"]), "left")

    def extended(w: Column, x: Column) -> Column:
        """The stretch of words (from, to) that a mark's words share with an item, null if it is no window's."""
        k, at, other = x["gram"], x["pos"] - 1, x["theirs"]
        long = F.size(other) == gram + 2 * side
        mine = F.slice(w, x["pos"], k)
        left = F.when(long, _extent(w, at - 1, other, side - 1, -1, side)).otherwise(0)
        right = F.when(long, _extent(w, at + gram, other, side + gram, 1, side)).otherwise(0)
        same = mine == F.when(long, F.slice(other, side + 1, gram)).otherwise(other)
        stretch = F.struct((at - left).alias("a"), (at + k + right).alias("b"), x["items"].alias("items"))
        return F.when(same, let(stretch, lambda s: F.when(~long | (s["b"] - s["a"] >= span), s)))

    empty = F.array().cast("array<struct<a:int,b:int,items:array<string>>>")
    met_or_none = F.coalesce(F.col("met"), F.array().cast(met.schema["met"].dataType))
    found = lambda w: F.array_sort(F.filter(F.transform(met_or_none, lambda x: extended(w, x)), lambda s: s.isNotNull()))
    spans = F.when(F.col("met").isNull(), empty).otherwise(let(alnum_words(F.col("text")), found))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(acc["end"], x["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    n_words = F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("long")
    out = both.select("doc", "text_hash", n_words.alias("n_words"), spans.alias("spans"))
    return out.select("doc", "text_hash", "n_words", covered.cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("spans.items"))).alias("items"))
