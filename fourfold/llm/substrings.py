"""Repeated-passage removal by prefix-partitioned suffix trees over words.

A window of ``span`` words is removed from a document if it also starts in a document with a smaller id.

1. Sieve. Of each window the k-gram with the least hash is its anchor; equal windows have equal anchors, so only suffixes
   whose window's anchor lies in two documents or more can repeat. Equal texts are settled first: all but the first are covered.
2. Prefixes. The other suffixes are split into groups that fit in memory by words that all equal windows share: by the anchor, and where it
   is met more than ``group_rows`` times, by a longer prefix, the words that all windows have whose anchor lies in one band of
   ``band`` places (``span`` - ``band`` + 1 words or more). Neighbouring suffixes of one group travel as one run of words, not one by one. A
   prefix that is frequent at that length too is a passage that so many documents repeat: its runs are dealt to parts by their document.
3. Trees. A partition is sorted (spilling to disk) and read once, group by group. A group's suffixes are put in word order by prefix
   doubling; neighbours with ``span`` words in common or more are the leaves of one deep internal node, whose depth (their common words) is
   the length of a maximal repeat. Words are compared, not hashes of windows. The first document of a node keeps the repeat. Where a prefix was
   dealt to several parts, the firsts of the parts are compared once more, by their words.
4. The repeats of a document are united; what they cover goes.

A document is its id and the MD5 of its text (ord, node) throughout: ord alone decides which is earlier, and rows that have one id, or none,
keep to their own stretches. Rows equal in both lose the same words and are worked on once.

Defined results: null and short texts lose nothing; ids may be of any type with an order; a null id counts as larger than any other; rows
with one id are never earlier than each other; other columns are not read. Tables are broadcast only after their bytes were summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .kernels import U64, Words, gram_hashes, mix64, slices, text_buffer

SPAN, GRAM, BAND = 50, 10, 8
#: Runs that a group should hold at most; bytes that may be broadcast; suffixes of a run at most.
GROUP_ROWS, BROADCAST_BYTES, _RUN = 500, 32 << 20, 64


def window_anchors(words: Words, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside rows, the place of each one's anchor, gram hashes by place, word hashes."""
    h = words.hashes()
    g = gram_hashes(h, gram)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), g, h
    bits = U64(max(24, int(len(g)).bit_length()))  # the same for all slices, so that equal windows have equal anchors
    least = (mix64(g) >> bits << bits) | np.arange(len(g), dtype=U64)
    width, want = 1, span - gram + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    starts = np.flatnonzero(words.row[:n] == words.row[span - 1 :])
    return starts, (least[starts] & ((U64(1) << bits) - U64(1))).astype(np.int64), g, h


def anchor_kernel(span: int, gram: int):
    """(ord, node, text) to the distinct (anchor, ord, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], False)
                _, anchors, g, _ = window_anchors(words, span, gram)
                at = np.unique(anchors)
                row = pa.array(words.row[at] + lo)
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)], ["anchor", "ord", "node"])

    return run


def leaf_kernel(span: int, gram: int, band: int, group_rows: int, hot_only: bool = False):
    """(ord, node, text, repeated anchors, their counts) to runs of suffixes: prefix, hot, ord, node, pos, words.

    A run is the suffixes at pos, pos + 1, ... that have one prefix: they travel as the words from the first one's first to the last one's
    ``span``-th. The prefix is the anchor; of a frequent anchor it is the ``span`` - ``band`` + 1 words or more that all windows have whose
    anchor lies in one band of places. With ``hot_only``, only the prefixes of runs at frequent anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(U64)
            often = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            begin = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for lo, hi in slices(offsets):
                text = data[offsets[lo] : offsets[hi]]
                words = Words(text, offsets[lo : hi + 1] - offsets[lo], False)
                starts, anchors, g, h = window_anchors(words, span, gram)
                known, count = flat[begin[lo] : begin[hi]], often[begin[lo] : begin[hi]]
                if not len(starts) or not len(known):
                    continue
                owner = np.repeat(np.arange(hi - lo, dtype=U64), np.diff(begin[lo : hi + 1]))
                known = mix64(known ^ mix64(owner + U64(1)))  # an anchor counts in the rows that list it
                order = np.argsort(known)
                known, count = known[order], count[order]
                mine = mix64(g[anchors] ^ mix64(words.row[starts].astype(U64) + U64(1)))
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                hot = count[at] > group_rows
                hit = (known[at] == mine) & (hot if hot_only else True)
                starts, anchors, hot = starts[hit], anchors[hit], hot[hit]
                if not len(starts):
                    continue
                prefix, place = g[anchors].copy(), (anchors - starts) // band
                for b in np.unique(place[hot]):
                    some = hot & (place == b)
                    left, right = int(b) * band, min(int(b) * band + band - 1, span - gram)
                    prefix[some] = mix64(gram_hashes(h, span - (right - left))[anchors[some] - left] + U64(b + 1))
                new = np.concatenate([[True], (np.diff(starts) != 1) | (prefix[1:] != prefix[:-1]) | (words.row[starts[1:]] != words.row[starts[:-1]])])
                nth = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
                first = np.flatnonzero(new | (nth % _RUN == 0))
                last = np.append(first[1:], len(starts)) - 1
                row = words.row[starts[first]]
                docs = pa.array(row + lo)
                raw, a, z = text.tobytes(), words.start[starts[first]].tolist(), words.end[starts[last] + span - 1].tolist()
                pieces = pa.array([b"" if hot_only else raw[i:j] for i, j in zip(a, z)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[first].view(np.int64)), pa.array(hot[first]), batch.column(0).take(docs), batch.column(1).take(docs), pa.array((starts[first] - words.first[row]).astype(np.int32)), pieces],
                    ["prefix", "hot", "ord", "node", "pos", "words"],
                )

    return run


def symbols(words: Words) -> np.ndarray:
    """The rank (from 1) of each word among the distinct ones, in byte order. Hashes find the distinct words, their bytes confirm them."""
    h, size = words.hashes(), words.end - words.start
    _, at, which = np.unique(h, return_index=True, return_inverse=True)
    upto = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(upto, size)
    same = np.array_equal(size, size[at][which]) and np.array_equal(words.data[np.repeat(words.start, size) + inside], words.data[np.repeat(words.start[at][which], size) + inside])
    raw = words.data.tobytes()
    if not same:  # two words of one hash
        each = [raw[a:z] for a, z in zip(words.start.tolist(), words.end.tolist())]
        ranks = {w: i for i, w in enumerate(sorted(set(each)), 1)}
        return np.array([ranks[w] for w in each], np.int64)
    distinct = [raw[a:z] for a, z in zip(words.start[at].tolist(), words.end[at].tolist())]
    rank = np.empty(len(at), np.int64)
    rank[sorted(range(len(at)), key=distinct.__getitem__)] = np.arange(1, len(at) + 1)
    return rank[which]


class Subtrees:
    """The suffix trees of some groups of runs, to depth ``span`` and, along their deep nodes, beyond it.

    Suffixes are put in word order by prefix doubling: ranks of the first 1, 2, 4, ... words of every suffix (0 is the end of its run). The
    leaves are the suffixes with ``span`` words; ``order`` lists them by group, words and row, ``node`` holds where in it each deep
    internal node begins (neighbours with at least ``span`` words in common have one), ``depth`` the words that all leaves of a node share.
    """

    def __init__(self, words: Words, group: np.ndarray, span: int):
        rank, k, n = symbols(words), 1, len(words.row)
        end = words.first[1:][words.row]
        self.levels: list[tuple[int, np.ndarray]] = [(1, rank)]

        def longer(rank: np.ndarray, by: int) -> np.ndarray:
            there = np.arange(by, n + by)
            tail = np.where(there < end, np.append(rank, np.zeros(by, np.int64))[by:], 0)
            return np.unique(rank * (n + 1) + tail, return_inverse=True)[1].astype(np.int64) + 1

        while 2 * k <= span:
            rank, k = longer(rank, k), 2 * k
            self.levels.append((k, rank))
        whole = longer(rank, span - k) if k < span else rank
        leaves = np.flatnonzero(end - np.arange(n) >= span)
        self.row = words.row[leaves]
        self.place = leaves - words.first[self.row]
        self.order = np.lexsort((np.arange(len(leaves)), whole[leaves], group[self.row]))
        at = leaves[self.order]
        g = group[self.row[self.order]]
        lcp = np.zeros(len(at), np.int64)  # with the leaf before
        near = np.flatnonzero((g[1:] == g[:-1]) & (whole[at[1:]] == whole[at[:-1]])) + 1
        lcp[near] = self._common(at[near - 1], at[near], end, span)
        self.node = np.flatnonzero(lcp < span)
        far = lcp.copy()
        far[self.node] = np.iinfo(np.int64).max
        self.depth = np.minimum.reduceat(far, self.node) if len(at) else lcp

    def _common(self, a: np.ndarray, b: np.ndarray, end: np.ndarray, known: int) -> np.ndarray:
        """The words that suffixes a and b share, ``known`` at least."""
        out, n = np.full(len(a), known, np.int64), len(end)
        live = np.arange(len(a))
        while len(live):  # whole steps of the longest level, then one of each shorter level
            grown = np.zeros(len(live), bool)
            for i, (k, rank) in enumerate(reversed(self.levels)):
                x, y = a[live] + out[live], b[live] + out[live]
                fits = (x + k <= end[a[live]]) & (y + k <= end[b[live]])
                same = fits & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
                out[live] += k * same
                grown |= same & (i == 0)
            live = live[grown]
        return out


def _repeats(t: pa.Table, span: int) -> pa.RecordBatch:
    """The repeats of whole groups of runs, in the order of part, prefix and ord: stretches of words, and windows that other parts must confirm."""
    t = t.combine_chunks()
    group = _groups(t)
    data, offsets = text_buffer(t.column(7).combine_chunks().cast(pa.large_binary()))
    words = Words(data, offsets, False)
    tree = Subtrees(words, group, span)
    ord_ = t.column(3).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    size = np.diff(np.append(tree.node, len(tree.order)))
    first, depth, kind = (np.empty(len(tree.order), np.int64) for _ in range(3))
    kind[tree.order] = np.repeat(np.arange(len(size)), size)
    first[tree.order] = np.repeat(tree.row[tree.order[tree.node]], size)  # of a node's leaves the one with the least ord comes first
    depth[tree.order] = np.repeat(tree.depth, size)
    row, place = tree.row, tree.place + t.column(5).to_numpy()[tree.row]
    sure = ord_[row] != ord_[first]
    begins = np.flatnonzero(sure & ~np.concatenate([[False], sure[:-1] & (row[1:] == row[:-1])]))
    upto = np.maximum.reduceat(np.append(np.where(sure, place + depth, 0), 0), begins) if len(begins) else begins
    doc = t.column(4).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ask = np.flatnonzero(t.column(2).to_numpy()[row] & ~sure)
    ask = ask[np.lexsort((place[ask], ord_[row[ask]], doc[row[ask]], kind[ask]))]  # a window that a document has many times asks once
    new = np.flatnonzero(np.concatenate([[True], (np.diff(kind[ask]) != 0) | (np.diff(doc[row[ask]]) != 0) | (np.diff(ord_[row[ask]]) != 0)])[: len(ask)])
    raw, head = words.data.tobytes(), words.first[row[ask[new]]] + tree.place[ask[new]]
    windows = [b" ".join(raw[a:z].split()) for a, z in zip(words.start[head].tolist(), words.end[head + span - 1].tolist())]
    docs = pa.array(np.concatenate([row[begins], row[ask[new]]]))
    spans = np.stack([np.concatenate([place[begins], place[ask]]), np.concatenate([upto, place[ask] + span])], 1).ravel().astype(np.int32)
    upto_ = 2 * np.concatenate([np.arange(len(begins)), len(begins) + new, [len(begins) + len(ask)]]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([None] * len(begins) + windows, pa.binary()), *(t.column(i).combine_chunks().take(docs) for i in (3, 4)), pa.ListArray.from_arrays(pa.array(upto_), pa.array(spans))], ["repeat", "ord", "node", "spans"])


def _groups(t: pa.Table) -> np.ndarray:
    """The number of each run's group: runs of one part and prefix."""
    part, prefix = t.column(0).to_numpy(), t.column(1).to_numpy()
    return np.cumsum(np.concatenate([[False], (np.diff(part) != 0) | (np.diff(prefix) != 0)])[: len(part)])


def tree_kernel(span: int):
    """Runs (part, prefix, dealt, ord, node, pos, hot, words) sorted by part, prefix and ord to (repeat, ord, node, spans: from, to, from, to, ...): words of a document
    that are repeated from an earlier one (repeat is null), or all places of a window that is the first of a part whose group was dealt to
    several. Whole groups are worked on together, as many as a batch holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = _groups(pa.Table.from_batches([batch]))
            last = [x.column(i)[-1] for x in held[-1:] for i in (0, 1)]
            cut_ = int(np.searchsorted(group, group[-1]))  # where the last group, which may go on, begins
            if held and (cut_ or last != [batch.column(i)[0] for i in (0, 1)]):
                yield _repeats(pa.Table.from_batches([*held, batch.slice(0, cut_)]), span)
                held = []
            elif cut_:
                yield _repeats(pa.Table.from_batches([batch.slice(0, cut_)]), span)
            held.append(batch.slice(cut_))
        if held:
            yield _repeats(pa.Table.from_batches(held), span)

    return run


def stretch_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, node, list of spans) to (ord, node, stretches): first word, end, first word, end, ... of their union."""
    for batch in batches:
        out = []
        for found in batch.column(2):
            flat = found.values.flatten().to_numpy(zero_copy_only=False)
            lo, hi = flat[::2], flat[1::2]
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            new = np.flatnonzero(lo[1:] > hi[:-1]) + 1
            out.append(np.stack([lo[np.concatenate([[0], new])], hi[np.concatenate([new - 1, [len(lo) - 1]])]], 1).ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["ord", "node", "stretches"])


def remover(span: int, with_text: bool):
    """(doc_id, text, copy, stretches) to doc_id, n_words, n_removed, kept_sha256 (and the kept text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            n, gone, sha, kept = [], [], [], []
            for i, (copy, cuts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3))):
                words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                n.append(len(words))
                if copy and len(words) >= span:
                    words = []
                elif cuts.is_valid:
                    edges, at, left = cuts.values.to_numpy(zero_copy_only=False), 0, []
                    for a, b in zip(edges[::2], edges[1::2]):
                        left += words[at:a]
                        at = b
                    words = left + words[at:]
                gone.append(n[-1] - len(words))
                text = b" ".join(words)
                sha.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text.decode())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.string())] if with_text else arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    return run


def _sized(df: DataFrame, size) -> DataFrame:
    """A kept table, marked for broadcast if its bytes (summed) allow."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, band: int = BAND, group_rows: int = GROUP_ROWS, with_text: bool = False) -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the text that stays)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("ord", F.col("doc_id")).withColumn("node", F.unhex(F.md5("text")))
    copies = docs.where("node IS NOT NULL").groupBy("node").agg(*_ids())
    copies = cut(copies.where(_SEVERAL).select("node", F.col("least").alias("earliest")))
    docs = docs.join(_sized(copies, F.lit(64)), "node", "left").withColumn("copy", _after("ord", "earliest"))
    first = docs.where("NOT copy AND text IS NOT NULL").select("ord", "node", "text")  # of one node only rows with its least ord

    anchors = first.mapInArrow(anchor_kernel(span, gram), f"anchor long, ord {kind}, node binary")
    # Kept, so that both sides of the join are shuffled for it alone and a very frequent anchor can be split.
    repeated = cut(anchors.groupBy("anchor").agg(*_ids()).where(_SEVERAL).select("anchor", "often"))
    listed = anchors.join(repeated, "anchor").groupBy("node").agg(F.collect_set(F.struct("anchor", "often")).alias("x"))
    listed = cut(listed.select("node", F.col("x.anchor").alias("anchors"), F.col("x.often").alias("often")))

    def runs(of: DataFrame, hot_only: bool) -> DataFrame:
        with_anchors = first.join(of, "node").select("ord", "node", "text", "anchors", "often")
        return with_anchors.mapInArrow(leaf_kernel(span, gram, band, group_rows, hot_only), f"prefix long, hot boolean, ord {kind}, node binary, pos int, words binary")

    leaves = runs(listed, False).withColumn("parts", F.lit(1))
    longer = listed.where(F.exists("often", lambda n: n > group_rows))
    if not longer.isEmpty():  # how often the lengthened prefixes are met: those that are frequent all the same are dealt
        counts = runs(longer, True).groupBy("prefix").count().where(F.col("count") > group_rows)
        counts = cut(counts.select("prefix", F.ceil(F.col("count") / group_rows).cast("int").alias("n")))
        leaves = leaves.join(_sized(counts, F.lit(16)), "prefix", "left").withColumn("parts", F.when(F.col("hot"), F.coalesce("n", F.lit(1))).otherwise(1))
    dealt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    leaves = leaves.select(F.xxhash64("prefix", dealt).alias("part"), "prefix", (F.col("parts") > 1).alias("dealt"), "ord", "node", "pos", "hot", "words")
    leaves = leaves.repartition(_partitions(docs), "part").sortWithinPartitions("part", "prefix", F.col("ord").asc_nulls_last())
    found = cut(leaves.mapInArrow(tree_kernel(span), f"repeat binary, ord {kind}, node binary, spans array<int>"))

    ask = found.where("repeat IS NOT NULL")
    earliest = ask.groupBy("repeat").agg(*_ids()).where(_SEVERAL).select("repeat", "least")
    later = ask.join(earliest, "repeat").where(_after("ord", "least")).select("ord", "node", "spans")
    starts = found.where("repeat IS NULL").select("ord", "node", "spans").union(later).groupBy("ord", "node").agg(F.collect_list("spans").alias("found"))
    stretches = cut(starts.mapInArrow(stretch_kernel, f"ord {kind}, node binary, stretches array<int>"))
    stretches = _sized(stretches.withColumnsRenamed({"ord": "ord_", "node": "node_"}), 96 + 4 * F.size("stretches"))
    whole = docs.join(stretches, (docs["node"] == stretches["node_"]) & docs["ord"].eqNullSafe(stretches["ord_"]), "left").select("doc_id", "text", "copy", "stretches")
    return whole.mapInArrow(remover(span, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)


#: Of some rows' ids: several of them, or one and rows without.
_SEVERAL = "least < most OR known > 0 AND known < often"


def _ids() -> list[Column]:
    return [F.min("ord").alias("least"), F.max("ord").alias("most"), F.count("ord").alias("known"), F.count("*").alias("often")]


def _after(ord_: str, least: str) -> Column:
    """Whether an id is larger than the least; none is larger than any other."""
    return F.coalesce(F.col(ord_) > F.col(least), F.col(ord_).isNull() & F.col(least).isNotNull())


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
