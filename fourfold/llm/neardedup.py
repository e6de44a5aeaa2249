"""Near-duplicate groups by BagMinHash signatures over multisets of word shingles.

Texts become multisets of five-word shingles. The weight axis is cut into the dyadic stretches (0,1], (1,2], (2,4], ...;
each stretch of each shingle has a Poisson process whose points carry a time and a register, and a stretch that a
weight covers in part is halved, each half continuing the process, until the halves are covered or not. A
register's signature is the least time among the points below the weights, so two registers are equal with a
probability that is the weighted Jaccard similarity; points later than the largest register are never drawn.
Bands of registers propose pairs, and the words of both texts decide: exact multiset Jaccard of at least ``threshold``.

With 24 bands of 4 registers a pair at 0.8 is missed with probability (1 - 0.8^4)^24 = 3e-6.

Scale: equal texts are one node (MD5), so copies cost a narrow aggregation. A bucket is not expanded into pairs: its members
are compared with one pivot, the member that shares the most buckets with others, which in a family of copies is mostly what they were
copied from. Only buckets whose members then still lie in different components are looked at again, those outside
the bucket's commonest component against the rest, so that no link is lost that would join two groups: in buckets of up to
``SMALL_BUCKET`` members pair by pair, in larger ones through an index of the shingles of a bounded block of members: the others go, in
blocks too, to each block of members, so a bucket costs its members once for each block of others, and these once for each block of
members. Texts are read again only for candidates. What is broadcast is counted first.

Defined results: a null text is alone in its group; equal texts always share one; a text of 1 to 4 words is one shingle; a text without
words is linked to equal texts only; repeated rows each get a row. The group id is the least doc_id of the group (null only if all are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .components import components
from .kernels import U64, Words, gram_hashes, mix64, slices, text_buffer, within

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 24, 4
#: Rows (of up to 50 bytes) that may be broadcast.
BROADCAST_ROWS = 400_000
#: Members up to which a bucket of several components is settled pair by pair; shingles of a block in a larger one.
SMALL_BUCKET, BLOCK_SHINGLES = 64, 250_000


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle; rows with fewer words than ``size``, but not none, have one."""
    h = words.hashes()
    at = within(words, size)
    rows, hashes = [words.row[at]], [gram_hashes(h, size)[at]]
    for n in range(1, size):
        short = np.flatnonzero(words.count == n)
        if len(short):
            rows.append(short)
            hashes.append(mix64(gram_hashes(h, n)[words.first[short]] + U64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def multiset(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) and how often each occurs."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return rows[at], hashes[at], np.diff(np.append(at, len(rows)))


def _exp(bits: np.ndarray) -> np.ndarray:
    return -np.log(((bits >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53)


def bagminhash(rows: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) signature times of weighted sets; rows without elements stay infinite.

    A node is a stretch (lo, lo + size] of one element's weight axis with one pending point (time, register). A covered
    node's point goes to its register. A node of size 1 then draws its next point; a larger one hands its point to one
    half, and the other half draws its first point after it. Both depend on element and stretch alone, never on the weight.
    """
    out = np.full(n_rows * m, np.inf)
    salt, turn = U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)

    def seeds(e, lo, size):
        return mix64(e ^ mix64(lo.astype(U64) * salt + size.astype(U64)))

    def draw(seed, k, rate):
        a = mix64(seed + k.astype(U64) * turn)
        return _exp(a) / rate, (mix64(a ^ salt) % U64(m)).astype(np.int64)

    parts = [(np.arange(len(rows)), 0, 1)]
    lo = 1
    while len(over := np.flatnonzero(weights > lo)):
        parts.append((over, lo, lo))
        lo *= 2
    elem = np.concatenate([p[0] for p in parts])
    low = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in parts])
    size = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in parts])
    k = np.zeros(len(elem), np.int64)
    time, reg = draw(seeds(hashes[elem], low, size), k, size)
    while len(elem):
        row, w = rows[elem], weights[elem]
        full = low + size <= w
        np.minimum.at(out, row[full] * m + reg[full], time[full])
        live = np.unique(row)
        most = np.full(n_rows, -np.inf)
        most[live] = out.reshape(n_rows, m)[live].max(axis=1)
        keep = time <= most[row]
        elem, low, size, k, time, reg, w = (x[keep] for x in (elem, low, size, k, time, reg, w))
        leaf = size == 1
        e1, l1, k1 = elem[leaf], low[leaf], k[leaf] + 1
        gap, r1 = draw(seeds(hashes[e1], l1, size[leaf]), k1, 1.0)
        e2, l2, half, t2 = elem[~leaf], low[~leaf], size[~leaf] // 2, time[~leaf]
        right = (mix64(seeds(hashes[e2], l2, size[~leaf]) ^ turn) & U64(1)).astype(np.int64)
        mine, other = l2 + right * half, l2 + (1 - right) * half
        gap2, r2 = draw(seeds(hashes[e2], other, half), np.zeros(len(e2), np.int64), half)
        zero = np.zeros(len(e2), np.int64)
        elem, low, size = np.concatenate([e1, e2, e2]), np.concatenate([l1, mine, other]), np.concatenate([np.ones(len(e1), np.int64), half, half])
        k, time, reg = np.concatenate([k1, zero, zero]), np.concatenate([time[leaf] + gap, t2, t2 + gap2]), np.concatenate([r1, reg[~leaf], r2])
        held = low < weights[elem]
        elem, low, size, k, time, reg = (x[held] for x in (elem, low, size, k, time, reg))
    return out.reshape(n_rows, m)


def signer(size: int, bands: int, per: int):
    """Arrow kernel: (node, text) to (node, n, keys), one key per band; rows without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True)
                rows, hashes = shingles(words, size)
                n = np.bincount(rows, minlength=hi - lo)
                sig = bagminhash(*multiset(rows, hashes), hi - lo, bands * per).view(U64).reshape(hi - lo, bands, per)
                key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), (hi - lo, bands)).copy()
                for j in range(per):
                    key = mix64(key ^ sig[:, :, j])
                some = np.flatnonzero(n)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * bands), pa.array(key[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(some)), pa.array(n[some].astype(np.int64)), keys], ["node", "n", "keys"])

    return run


def similarities(left: pa.Array, right: pa.Array, size: int) -> np.ndarray:
    """The multiset Jaccard similarity of each pair of texts."""
    (da, oa), (db, ob) = text_buffer(left), text_buffer(right)
    out = np.zeros(len(oa) - 1)
    for lo, hi in slices(oa + ob):
        (ra, ha), (rb, hb) = (shingles(Words(d[o[lo] : o[hi]], o[lo : hi + 1] - o[lo], True), size) for d, o in ((da, oa), (db, ob)))
        (ra, ha, ca), (rb, hb, cb) = multiset(ra, ha), multiset(rb, hb)
        r, h, c = np.concatenate([ra, rb]), np.concatenate([ha, hb]), np.concatenate([ca, cb])
        order = np.lexsort((h, r))
        r, h, c = r[order], h[order], c[order]
        twin = np.flatnonzero((r[1:] == r[:-1]) & (h[1:] == h[:-1]))
        shared = np.bincount(r[twin], np.minimum(c[twin], c[twin + 1]), hi - lo)
        total = np.bincount(r, c, hi - lo) - shared
        out[lo:hi] = np.divide(shared, total, out=np.zeros(hi - lo), where=total > 0)
    return out


def verifier(size: int, threshold: float):
    """Arrow kernel: (a, b, text of a, text of b) to the pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(similarities(batch.column(2), batch.column(3), size) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["a", "b"])

    return run


def cross_links(texts: pa.Array, labels: np.ndarray, asks: np.ndarray, size: int, threshold: float) -> Iterator[tuple[int, int]]:
    """For each row that asks, one similar row of every other label that has one among the rows that do not: exact, by the shingles' postings."""
    data, offsets = text_buffer(texts)
    n, parts = len(labels), []
    for lo, hi in slices(offsets):
        r, h, c = multiset(*shingles(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], True), size))
        parts.append((r + lo, h, c))
    row, hashes, count = (np.concatenate(x) for x in zip(*parts))
    total = np.bincount(row, count, n)
    begin = np.searchsorted(row, np.arange(n + 1))
    order = np.argsort(hashes, kind="stable")
    held = ~asks[row[order]]  # the entries of rows that ask are in no posting
    by, new = row[order], np.flatnonzero(np.concatenate([[True], np.diff(hashes[order].view(np.int64)) != 0]))
    which = np.empty(len(row), np.int64)  # the posting list of each entry
    which[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(row))))
    end, often = np.append(new[1:], len(row)), np.where(held, count[order], 0)
    for x in np.flatnonzero(asks):
        lists, mine = which[begin[x] : begin[x + 1]], count[begin[x] : begin[x + 1]]
        sizes = end[lists] - new[lists]
        at = np.repeat(new[lists] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        shared = np.bincount(by[at], np.minimum(np.repeat(mine, sizes), often[at]), n)
        near = np.flatnonzero((shared >= (threshold - 1e-12) * (total[x] + total - shared)) & (labels != labels[x]) & (shared > 0))
        for y in near[np.unique(labels[near], return_index=True)[1]]:
            yield x, int(y)


def cross_kernel(size: int, threshold: float):
    """Rows (task, node, label, asks, text) sorted by task to similar pairs (a, b) of different labels. A task's rows are held together."""

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        nodes = t.column(1).to_pylist()
        labels = np.unique(np.array(t.column(2).to_pylist(), object), return_inverse=True)[1]
        pairs = list(cross_links(t.column(4), labels, np.array(t.column(3).to_pylist()), size, threshold))
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[i]] for p in pairs], pa.binary()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, task = [], None
        for batch in batches:
            tasks = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(tasks)) + 1).tolist(), len(tasks)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo:
                    if held and tasks[lo] != task:
                        yield settle(held)
                        held = []
                    task = tasks[lo]
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield settle(held)

    return run


def _counted(df: DataFrame) -> DataFrame:
    """A kept table, marked for broadcast where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document row: doc_id, node (MD5 of its text), group_id, group_node (with group_id, the document that stands for the group)."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("node"), F.col(text).alias("text"))
    signed = ids.where("node IS NOT NULL").select("node", "text").mapInArrow(signer(size, bands, rows), "node binary, n long, keys array<long>")
    signed = cut(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")))
    members = signed.select("node", "n", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = cut(members.join(buckets, "key"))  # only buckets of two and more
    central = shared.groupBy("node").agg(F.sum("c").alias("met"))
    pivots = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("met", "node", "n")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"))
    near_size = lambda x, y: (F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9)

    def texts_of(nodes: DataFrame) -> DataFrame:
        wanted = cut(nodes.distinct())
        return cut(ids.join(_counted(wanted), "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text")))

    def verified(pairs: DataFrame) -> DataFrame:
        texts = texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        two = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return cut(two.select("a", "b", "ta", "tb").mapInArrow(verifier(size, threshold), "a binary, b binary"))

    tried = shared.join(pivots, "key").where((F.col("node") != F.col("pivot")) & near_size(F.col("n"), F.col("pivot_n")))
    tried = cut(tried.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct())
    edges = verified(tried)
    labels = components(edges)

    placed = shared.join(_counted(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = placed.groupBy("key", "label").agg(F.count("*").alias("count"), F.sum("n").alias("n")).groupBy("key")
    split = split.agg(F.count("*").alias("kinds"), F.max(F.struct("count", "label", "n")).alias("main"), F.sum("n").alias("all_n")).where("kinds > 1")
    split = split.select("key", F.col("main.label").alias("main"), "all_n", (F.col("all_n") - F.col("main.n")).alias("minor_n"))
    mixed = cut(placed.join(split, "key").withColumn("minor", F.col("label") != F.col("main")))
    small = mixed.where(F.col("c") <= SMALL_BUCKET)
    minor = small.where("minor").select("key", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("label").alias("xl"))
    rest = minor.join(small, "key").where((F.col("xl") != F.col("label")) & near_size(F.col("n"), F.col("xn")) & (~F.col("minor") | (F.col("x") < F.col("node"))))
    rest = cut(rest.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    more = [] if rest.isEmpty() else [verified(rest)]
    large = mixed.where(F.col("c") > SMALL_BUCKET)
    if not large.isEmpty():
        of = lambda n: F.ceil(F.col(n) / BLOCK_SHINGLES).cast("int")
        mine, other = F.pmod(F.xxhash64("node"), of("all_n")), F.pmod(F.xxhash64("node", F.lit(1)), of("minor_n"))
        listed = F.transform(F.sequence(F.lit(0), of("minor_n") - 1), lambda i: F.struct(F.xxhash64("key", i, mine.cast("int")).alias("task"), F.lit(False).alias("asks")))
        asking = F.transform(F.sequence(F.lit(0), of("all_n") - 1), lambda j: F.struct(F.xxhash64("key", other.cast("int"), j).alias("task"), F.lit(True).alias("asks")))
        places = F.when(F.col("minor"), F.concat(listed, asking)).otherwise(listed)
        rows_ = large.join(texts_of(large.select("node")), "node").select(F.explode(places).alias("p"), "node", "label", "text").select("p.task", "node", "label", "p.asks", "text")
        rows_ = rows_.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")
        more.append(cut(rows_.mapInArrow(cross_kernel(size, threshold), "a binary, b binary")))
    more = [m for m in more if not m.isEmpty()]
    for m in more:
        edges = edges.union(m)
    if more:
        labels = components(edges)

    narrow = ids.select("doc_id", "node").join(_counted(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    # Kept, so that the join back to a large group's rows can be split.
    heads = cut(narrow.where("label IS NOT NULL").groupBy("label").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "node"))).alias("head"), F.min("node").alias("any_node")))
    joined = narrow.join(heads, "label", "left")
    alone = F.col("label").isNull()
    return joined.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("group_id"), F.when(~alone, F.coalesce("head.node", "any_node")).alias("group_node"))
