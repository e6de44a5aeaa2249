"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by normalised overlap.

1. The entropy of every window of 64 bytes is put on a scale of 0 to 255. A first pass counts the scale over all documents;
   the rarer a value, the lower (better) its rank.
2. Within every run of 64 consecutive windows the best rank, leftmost, gets a point. Windows that win at least 16 points are the
   text's improbable features. Windows of nearly constant bytes are no features.
3. Features enter Bloom filters of 1,024 bits by three hashes, 64 features to a filter, then the next filter is chained.
4. Two digests are compared filter by filter: shared bits less those expected by chance, over the most that could be shared, 0 below a
   cut-off; each filter of the shorter digest counts with its best match, and the mean is the likeness.

A text shorter than a window, or without a winning window, has its whole bytes as its one feature; an empty text has the empty digest, which is
like itself (1) and like nothing else (0).

For the query, documents are put in descending order of id without gathering them: ids are cut into ranges at quantiles, a range is one
sorted stream, and the first document of each range is also sent to the end of the range before it. Memory holds two documents at
a time besides the batch. Rows with one id follow each other by MD5 of their texts; null ids come last. The document after the last is
the first; a lone document follows itself. Ids may be whole numbers, text (by code point) or any number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, let
from .kernels import U64, mix64, slices, text_buffer

WINDOW, POPULAR, SCALE = 64, 16, 256
FILTER_BITS, HASHES, PER_FILTER = 1024, 3, 64
#: Entropies (of the scale) below this are no features.
LEAST = 16
#: The share of the attainable overlap above chance that counts as none.
CUT_OFF = 0.3
_UNIT = 1 << 24
_C = np.arange(WINDOW + 2)
_G = np.rint(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * _UNIT).astype(np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """The scaled entropy (0 to SCALE - 1) of each window of WINDOW bytes."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for s in range(1, WINDOW):
        same = (data[s:] == data[:-s]).view(np.uint8)
        before[s:] += same
        after[:-s] += same
    start = int(_G[np.bincount(data[:WINDOW], minlength=256)].sum())
    change = (_G[after[: n - WINDOW]] - _G[after[: n - WINDOW] + 1]) + (_G[before[WINDOW:] + 1] - _G[before[WINDOW:]])
    total = np.concatenate([[start], start + np.cumsum(change)])
    most = np.log2(WINDOW)
    return np.clip(((most - total / _UNIT / WINDOW) / most * (SCALE - 1e-6)).astype(np.int64), 0, SCALE - 1)


def features(data: np.ndarray, scaled: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the improbable windows of one text, in their order."""
    if not len(data):
        return np.zeros(0, U64)
    n = len(scaled)
    if n:
        rank = np.where(scaled < LEAST, len(ranks), ranks[scaled]).astype(np.int64)
        key = rank * (1 << 40) + np.arange(n)
        width = 1
        want = min(WINDOW, n)
        least = key
        while width * 2 <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        points = np.bincount(least & ((1 << 40) - 1), minlength=n)
        at = np.flatnonzero((points >= min(POPULAR, len(least))) & (rank < len(ranks)))
        if len(at):
            rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].copy().view(U64)
            h = np.zeros(len(at), U64)
            for j in range(rows.shape[1]):
                h = mix64(h ^ rows[:, j]) + U64(j)
            return h
    return np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), U64)


def digest(found: np.ndarray) -> np.ndarray:
    """The chained filters: (filters, bits) booleans."""
    if not len(found):
        return np.zeros((0, FILTER_BITS), bool)
    which = np.arange(len(found)) // PER_FILTER
    out = np.zeros((which[-1] + 1, FILTER_BITS), bool)
    h = mix64(found)
    for j in range(HASHES):
        out[which, ((h >> U64(20 * j)) % U64(FILTER_BITS)).astype(np.int64)] = True
    return out


def encode(filters: np.ndarray) -> str:
    return base64.b64encode(np.packbits(filters).tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(text), np.uint8)).reshape(-1, FILTER_BITS).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; symmetric up to which digest has fewer filters, 1 for equal digests."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    x, y = a.astype(np.float32), b.astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    both, most, chance = x @ y.T, np.minimum(nx, ny), nx * ny / FILTER_BITS
    floor = chance + CUT_OFF * (most - chance)
    score = np.where(both > floor, (both - floor) / np.maximum(most - floor, 1e-9), 0.0)
    return float(min(1.0, score.max(axis=1).mean()))


def entropies_of(texts: list[bytes], most: int = 1 << 18) -> list[np.ndarray]:
    """The entropies of each text's windows (as bytes), worked out for neighbouring texts together."""
    out, lo = [], 0
    while lo < len(texts):
        hi, held = lo + 1, len(texts[lo])
        while hi < len(texts) and held + len(texts[hi]) <= most:
            held += len(texts[hi])
            hi += 1
        scaled, at = entropies(np.frombuffer(b"".join(texts[lo:hi]), np.uint8)).astype(np.uint8), 0
        for t in texts[lo:hi]:
            out.append(scaled[at : at + max(0, len(t) - WINDOW + 1)])
            at += len(t)
        lo = hi
    return out


def _texts(column: pa.Array, most: int = 1 << 20):
    """Row range and texts, some at a time; null reads as empty."""
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets, most):
        yield lo, [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(lo, hi)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SCALE, np.int64)
    for batch in batches:
        for _, texts in _texts(batch.column(0)):
            total += np.bincount(np.concatenate(entropies_of(texts)), minlength=SCALE)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(SCALE, dtype=np.int32)), pa.array(total)], ["value", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks of the entropy scale, counted over every window of every document: 0 is the rarest."""
    n = np.zeros(SCALE, np.int64)
    for value, count in docs.select(text).mapInArrow(_counts, "value int, n long").groupBy("value").agg(F.sum("n")).collect():  # SCALE rows
        n[value] = count
    order = np.lexsort((np.arange(SCALE), n))
    ranks = np.empty(SCALE, np.int64)
    ranks[order] = np.arange(SCALE)
    return ranks


def _chars(raw: bytes) -> np.ndarray:
    """Byte offsets of the code points, and the end."""
    b = np.frombuffer(raw, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(b))


def chain_kernel(ranks: np.ndarray):
    """Rows (part, last, doc_id, text) sorted by part and order to the query's rows; ``last`` marks a copy of the next range's first."""

    def edit(raw: bytes, following: bytes) -> tuple[int, bytes, int]:
        chars, ahead = _chars(raw), _chars(following)
        n = len(chars) - 1
        keep = int(chars[n - n // 3])
        return n, raw[:keep] + following[: ahead[min(n // 3, len(ahead) - 1)]], max(0, keep - WINDOW + 1)

    def of(raw: bytes, scaled: np.ndarray) -> np.ndarray:
        return digest(features(np.frombuffer(raw, np.uint8), scaled, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            parts, lasts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, texts in _texts(batch.column(3)):
                pairs = []
                for i, (raw, scaled) in enumerate(zip(texts, entropies_of(texts)), lo):
                    now = (parts[i], ids[i], raw, scaled, of(raw, scaled))
                    if held is not None and held[0] == parts[i]:
                        pairs.append((held, now, *edit(held[2], raw)))
                    held = None if lasts[i] else now
                tails = entropies_of([edited[settled:] for _, _, _, edited, settled in pairs])
                out = []
                for (held_, now, n, edited, settled), tail in zip(pairs, tails):
                    _, doc_id, raw, scaled, mine = held_
                    other = mine if edited == raw else of(edited, np.concatenate([scaled[:settled], tail]))
                    out.append((doc_id, n, hashlib.sha256(edited).hexdigest(), encode(mine), encode(other), likeness(mine, other), likeness(mine, now[4])))
                names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
                types = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                columns = list(zip(*out)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def _below(edges: list[int], key: Column) -> Column:
    """How many of the sorted edges are below the key, by way of every so-manyth edge."""
    step = max(1, int(len(edges) ** 0.5))
    all_, some = (F.array(*map(F.lit, x)).cast("array<double>" if edges and isinstance(edges[0], float) else "array<long>") for x in (edges, edges[step - 1 :: step]))
    coarse = let(F.size(F.filter(some, lambda e: e < key)) * step, lambda at: at + F.size(F.filter(F.slice(all_, at + 1, step), lambda e: e < key)))
    return F.when(key.isNotNull(), coarse)


def _descending(key: Column, kind: str) -> tuple[Column, Column]:
    """Two columns that ascend where the key descends: a number for ranges and what tells keys of one number apart."""
    if kind in ("string", "binary"):
        digits = F.hex(key.cast("binary"))
        back = F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))  # a text comes before its beginnings
        return -F.conv(F.rpad(F.substring(digits, 1, 14), 14, "0"), 16, 10).cast("long"), back
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return -key.cast("long"), F.lit("")
    return -key.cast("double"), F.lit("")


def fingerprint_chain(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rows_per_range: int = 4000) -> DataFrame:
    """Each document's digest, the digest of its edited text, and their likeness to each other and to the next document's."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    ranks = rarity(docs)
    o, k = _descending(F.col("doc_id"), kind)
    narrow = docs.select(o.alias("o"))
    n = narrow.count()
    if not n:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # Range edges: a bounded list, exact quantiles are not needed. The key is -id so that streams ascend; nulls go last.
    ranges = max(1, min(10_000, n // rows_per_range))
    edges = sorted(set(narrow.select(F.percentile_approx("o", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])) if ranges > 1 else []
    part = F.coalesce(_below(edges, o), F.lit(len(edges))) if edges else F.lit(0)
    none = F.col("doc_id").isNull().cast("int")
    placed = docs.select("doc_id", "text", part.alias("part"), F.struct(none.alias("none"), F.coalesce(o, F.lit(0)).alias("o"), F.coalesce(k, F.lit("")).alias("k"), F.coalesce(F.md5("text"), F.lit("")).alias("m")).alias("at"))
    heads = cut(placed.groupBy("part").agg(F.min("at").alias("at")))
    present = sorted(r[0] for r in heads.select("part").collect())  # range numbers: at most 10,000
    before = {p: present[i - 1] for i, p in enumerate(present)}  # the first range follows the last
    mapping = docs.sparkSession.createDataFrame(list(before.items()), "part int, earlier int")
    first = F.broadcast(heads.join(F.broadcast(mapping), "part"))
    copies = placed.join(first, ["part", "at"]).groupBy("earlier").agg(F.any_value(F.struct("doc_id", "text", "at")).alias("x")).select(F.col("earlier").alias("part"), F.lit(True).alias("last"), "x.at", "x.doc_id", "x.text")
    stream = placed.select("part", F.lit(False).alias("last"), "at", "doc_id", "text").unionByName(copies)
    stream = stream.repartition(max(len(present), 1), "part").sortWithinPartitions("part", "last", "at").select("part", "last", "doc_id", "text")
    return stream.mapInArrow(chain_kernel(ranks), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
