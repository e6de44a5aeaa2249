"""Language identification by a linear-chain conditional random field over words.

Every word is labelled with a language. A word's score for a label sums the weights of its features (prefixes and suffixes of 1 to 3 letters,
character bigrams and trigrams, and its entry in a lexicon of training words); learned transition weights join neighbours, so that
code-switched text is labelled stretch by stretch. Forward-backward gives each word's label distribution; a document's
language is the label with the largest mean, and that mean is the score.

Words are the same in training and prediction (``words_of``): runs of ASCII letters and non-ASCII characters, of which the letters count.

Training: maximum conditional likelihood with an L2 penalty by full-batch adaptive gradient steps, on the driver, from a bounded sample: at most
``per_label`` labelled documents of each label, every label that training rows have, and about ``samples`` documents in all (where there are more
labels than samples / per_label, fewer of each, one at least), chosen by hash of the id, and at most ``sample_chars`` characters of each, from a
place given by the hash. The model has ``_CELLS_MODEL`` weights at most: beyond that, the commonest features. A step goes through the sequences in
slices of bounded memory. Half of the training sequences splice two languages, which teaches the transitions what a switch
costs. Prediction runs over all words of all texts, in Arrow batches, without a shuffle. Long texts are cut into chunks: with few labels the
chunks' transfer matrices are multiplied first, with many the messages are passed from chunk to chunk; both are exact.

Memory of a worker: an Arrow batch of bounded bytes (a longer text is a batch of its own), arrays over one slice of it, and a table of word scores
of ``_CACHE_BYTES`` at most, which is grown in place and begun anew when it is full.

Defined results: a null text and one without a letter get ``und`` and score 0. Labels are the non-null languages of training rows; without any
every text is ``und``. Repeated rows get equal rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches
from .kernels import _LOWER, Words, slices, text_buffer

PER_LABEL, SAMPLES, SAMPLE_CHARS = 150, 9600, 2000
_SEQUENCE, _STEPS, _L2, _RATE = 40, 60, 1e-4, 0.25
#: Numbers (sequences times words times labels) that training works on at once.
_CELLS, _CELLS_MODEL = 1 << 21, 1 << 25
#: Bytes of word scores that a worker keeps (a word has some 160 besides them); words of a chunk; labels up to which transfer matrices pay.
_CACHE_BYTES, _CHUNK, _FEW = 48 << 20, 32, 16
#: Text bytes, times the labels over four, that prediction works on at once.
_SLICE = 512 << 10
_RUN, _LETTERS = re.compile(r"[A-Za-z\u0080-\U0010ffff]+"), re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def normal(run: str) -> str:
    """The word that a run of ASCII letters and non-ASCII characters is: its letters, lower-cased; empty if it has none."""
    return "".join(_LETTERS.findall(run.lower()))


def words_of(text: str) -> list[str]:
    """The words of a text, as prediction sees them."""
    return [w for run in _RUN.findall(text) if (w := normal(run))]


def word_features(word: str) -> list[str]:
    """The feature names of a lower-cased word."""
    w, n = f"^{word}$", len(word)
    return [
        *(f"p{word[:k]}" for k in range(1, min(3, n) + 1)),
        *(f"s{word[-k:]}" for k in range(1, min(3, n) + 1)),
        *(f"g{w[i : i + 2]}" for i in range(n + 1)),
        *(f"g{w[i : i + 3]}" for i in range(n)),
        f"w{word}",
    ]


@dataclass
class Crf:
    """labels; feature index; weights (features, labels); transition and start weights."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Label scores of each word."""
        flat, ends, get = [], [], self.index.get
        for word in words:
            flat.extend(i for f in word_features(word) if (i := get(f)) is not None)
            ends.append(len(flat))
        sums = np.zeros((len(flat) + 1, len(self.labels)))
        np.cumsum(self.weights[flat], axis=0, out=sums[1:])
        ends = np.array(ends, np.int64)
        return sums[ends] - sums[np.concatenate([[0], ends[:-1]])] if len(ends) else sums[:0]

    def posteriors(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The label distribution of each word by forward-backward; words of all sequences in a row."""
        n, k = scores.shape
        out = np.empty((n, k))
        lengths = np.asarray(lengths)
        lengths = lengths[lengths > 0]
        if not n:
            return out
        step, start = np.exp(self.transitions), np.exp(self.start)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        chunks = -(-lengths // _CHUNK)
        first_chunk, first_word = np.cumsum(chunks) - chunks, np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(lengths)), chunks)
        nth = np.arange(chunks.sum()) - first_chunk[owner]
        at = first_word[owner] + nth * _CHUNK
        size = np.minimum(_CHUNK, lengths[owner] - nth * _CHUNK)
        place = np.minimum(at[:, None] + np.arange(_CHUNK), n - 1)
        valid = np.arange(_CHUNK) < size[:, None]
        e = np.where(valid[:, :, None], e[place], 1.0)
        opening = nth == 0

        def forward(a, t):  # rows (chunks, ..., k); the first word of a sequence has no transition
            moved = np.where(opening[(slice(None),) + (None,) * (a.ndim - 1)], a, a @ step) if t == 0 else a @ step
            return moved * e[:, t].reshape(len(a), *(1,) * (a.ndim - 2), k)

        few = k <= _FEW
        total = np.broadcast_to(np.eye(k), (len(at) if few else 0, k, k))
        for t in range(_CHUNK if few else 0):
            new = forward(total, t)
            new /= new.max(axis=(1, 2), keepdims=True)
            total = np.where(valid[:, t, None, None], new, total)
        into, outof = np.empty((len(at), k)), np.empty((len(at), k))

        def across(a, chunk, back):  # one row for each chunk: the message carried through it, word by word
            if few:
                return np.einsum("nij,nj->ni" if back else "ni,nij->nj", *((total[chunk], a) if back else (a, total[chunk])))
            for t in range(_CHUNK - 1, -1, -1) if back else range(_CHUNK):
                live = valid[chunk, t, None]
                if back:
                    new = e[chunk, t] * a
                    new = np.where(opening[chunk, None] & (t == 0), new, new @ step.T)
                else:
                    new = np.where(opening[chunk, None] & (t == 0), a, a @ step) * e[chunk, t]
                a = np.where(live, new / new.sum(axis=1, keepdims=True), a)
            return a
        now, order = np.broadcast_to(start, (len(lengths), k)).copy(), np.argsort(-chunks, kind="stable")
        counts = np.searchsorted(-chunks[order], -np.arange(chunks.max()), "left")
        for c in range(chunks.max()):
            live = order[: counts[c]]
            into[first_chunk[live] + c] = now[live]
            new = across(now[live], first_chunk[live] + c, False)
            now[live] = new / new.sum(axis=1, keepdims=True)
        now = np.ones((len(lengths), k))
        for c in range(chunks.max() - 1, -1, -1):
            live = order[: counts[c]]
            outof[first_chunk[live] + c] = now[live]
            new = across(now[live], first_chunk[live] + c, True)
            now[live] = new / new.sum(axis=1, keepdims=True)
        ahead, a = np.empty((len(at), _CHUNK, k)), into
        for t in range(_CHUNK):
            new = forward(a, t)
            new /= new.sum(axis=1, keepdims=True)
            a = np.where(valid[:, t, None], new, a)
            ahead[:, t] = a
        b = outof
        for t in range(_CHUNK - 1, -1, -1):
            ahead[:, t] *= b
            new = (e[:, t] * b) @ step.T
            b = np.where(valid[:, t, None], new / new.sum(axis=1, keepdims=True), b)
        ahead /= ahead.sum(axis=2, keepdims=True)
        out[place[valid]] = ahead[valid]
        return out


def train(samples: list[tuple[str, str]], steps: int = _STEPS) -> Crf:
    """A field from (language, text) pairs."""
    labels = sorted({lang for lang, _ in samples})
    pure = [(labels.index(lang), w) for lang, text in samples for words in [words_of(text)] for i in range(0, len(words), _SEQUENCE) if (w := words[i : i + _SEQUENCE])]
    rng = np.random.default_rng(7)
    sequences = [(w, [y] * len(w)) for y, w in pure]
    if len(labels) > 1:
        for i, j in zip(range(len(pure)), rng.permutation(len(pure))):
            (ya, a), (yb, b) = pure[i], pure[j]
            if ya != yb:
                a, b = a[: max(1, len(a) // 2)], b[len(b) // 2 :]
                sequences.append((a + b, [ya] * len(a) + [yb] * len(b)))
    if not sequences:
        return Crf(labels, {}, np.zeros((0, len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
    seen = Counter(x for w, _ in sequences for x in w)
    vocabulary = {x: i for i, x in enumerate(seen)}
    names = Counter(f for x in vocabulary for f in word_features(x))
    room = max(1, _CELLS_MODEL // len(labels))
    kept = sorted((f for f, c in names.items() if c > 1 or f[0] == "w" and seen[f[1:]] > 2), key=lambda f: (-names[f], f))[:room]
    index = {f: i for i, f in enumerate(sorted(kept))}
    entries = [[index[f] for f in word_features(x) if f in index] for x in vocabulary]
    word_of, feature = np.repeat(np.arange(len(entries)), [len(x) for x in entries]), np.array([f for x in entries for f in x], np.int64)
    k, longest, m = len(labels), max(len(w) for w, _ in sequences), len(sequences)
    words, truth, valid = np.zeros((m, longest), np.int64), np.zeros((m, longest), np.int64), np.zeros((m, longest), bool)
    for i, (w, y) in enumerate(sequences):
        words[i, : len(w)], truth[i, : len(w)], valid[i, : len(w)] = [vocabulary[x] for x in w], y, True
    pairs = valid[:, 1:] & valid[:, :-1]
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    weights, step, start = np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)
    state = [np.full(x.shape, 1e-8) for x in (weights, step, start)]
    for _ in range(steps):
        known = np.stack([np.bincount(word_of, weights[feature, j], len(entries)) for j in range(k)], 1)
        wrong, expected, opening = np.zeros((len(entries), k)), np.zeros((k, k)), np.zeros(k)
        rows = max(1, _CELLS // (longest * k))
        for lo in range(0, m, rows):
            part = slice(lo, lo + rows)
            errors, moved, first = _errors(known, step, start, words[part], truth[part], valid[part])
            wrong += errors
            expected += moved
            opening += first
        grads = [np.stack([np.bincount(feature, wrong[word_of, j], len(index)) for j in range(k)], 1), seen_pairs - expected, opening]
        for x, g, s in zip((weights, step, start), grads, state):
            g = g / m - _L2 * x
            s += g * g
            x += _RATE * g / np.sqrt(s)
    return Crf(labels, index, weights, step, start)


def _errors(known: np.ndarray, step: np.ndarray, start: np.ndarray, words: np.ndarray, truth: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some sequences: the summed error of each word of the vocabulary, expected transitions, the summed error of first words."""
    (m, longest), k = words.shape, known.shape[1]
    scores = known[words]
    e = np.exp(scores - scores.max(axis=2, keepdims=True)) * valid[:, :, None] + ~valid[:, :, None]
    move = np.exp(step)
    a, scale = np.empty((m, longest, k)), np.ones((m, longest))
    for t in range(longest):
        new = (np.exp(start) if t == 0 else a[:, t - 1] @ move) * e[:, t]
        scale[:, t] = new.sum(axis=1)
        a[:, t] = np.where(valid[:, t, None], new / scale[:, t, None], a[:, t - 1] if t else new)
    b, expected, gamma = np.ones((m, k)), np.zeros((k, k)), np.empty((m, longest, k))
    for t in range(longest - 1, -1, -1):
        gamma[:, t] = a[:, t] * b
        gamma[:, t] /= gamma[:, t].sum(axis=1, keepdims=True)
        if t:
            right = e[:, t] * b / scale[:, t, None]
            live = valid[:, t]
            expected += move * (a[:, t - 1][live].T @ right[live])
            b = np.where(live[:, None], right @ move.T, b)
    error = np.eye(k)[truth] - gamma
    flat, of = error[valid], words[valid]
    return np.stack([np.bincount(of, flat[:, j], len(known)) for j in range(k)], 1), expected, error[:, 0].sum(axis=0)


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id's text is 2 modulo 4; a null id reads as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_label: int = PER_LABEL, samples: int = SAMPLES, sample_chars: int = SAMPLE_CHARS) -> Crf:
    """The field trained on rows that are not held out: samples of sample_chars, per_label of each label and ``samples`` in all at most (or one of each
    label) reach the driver."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    labels = rows.select(F.count_distinct("lang")).first()[0]
    per_label = max(1, min(per_label, samples // max(1, labels)))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = ids.withColumn("nth", nth).where(F.col("nth") <= per_label).select("doc_id", "lang", "h").distinct()
    begin = F.pmod("h", F.greatest(F.lit(1), F.length("text") - sample_chars)).cast("int") + 1
    some = rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", F.substring("text", begin, F.lit(sample_chars)).alias("text")).distinct()
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("text"))).where(F.col("nth") <= per_label)  # ids can repeat
    return train(sorted((r.lang, r.text) for r in some.collect()))


_GAP = np.ones(256, bool)
_GAP[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class _Letters(Words):
    """Words are runs of ASCII letters and non-ASCII characters, lower-cased in ASCII for hashing."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        blanked = _LOWER[data]
        blanked[_GAP[data]] = 0x20
        super().__init__(blanked, offsets, False)


def labelled(crf: Crf, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Slices of the batches, with the language and score of each row's text (column number ``text``)."""
    table, known, most = np.zeros((1024, len(crf.labels))), {}, _CACHE_BYTES // (160 + 8 * max(1, len(crf.labels)))

    def rows_of(words: _Letters) -> np.ndarray:
        """For each word the row of its scores, -1 without a letter."""
        nonlocal table
        hashes, at, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        if len(known) + len(keys) > most:
            known.clear()
        new = [i for i, h in enumerate(keys) if h not in known]
        texts = [normal(words.data[words.start[at[i]] : words.end[at[i]]].tobytes().decode()) for i in new]
        base = len(known)
        if base + len(new) > len(table):
            table.resize((max(base + len(new), min(2 * len(table), most)), table.shape[1]), refcheck=False)
        table[base : base + len(new)] = crf.emissions(texts)
        known.update((keys[i], base + n if t else -1) for n, (i, t) in enumerate(zip(new, texts)))
        return np.array([known[h] for h in keys], np.int64)[which] if keys else np.zeros(0, np.int64)

    for batch in batches:
        data, offsets = text_buffer(batch.column(text))
        for lo, hi in slices(offsets, max(1, _SLICE * 4 // max(4, len(crf.labels)))):
            words = _Letters(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            row = rows_of(words)
            some, owner = row >= 0, words.row[row >= 0]
            count = np.bincount(owner, minlength=hi - lo)
            mass = np.zeros((hi - lo, max(1, len(crf.labels))))
            if some.any() and crf.labels:
                post = crf.posteriors(table[row[some]], count)
                mass = np.stack([np.bincount(owner, post[:, j], hi - lo) for j in range(len(crf.labels))], 1)
            best = mass.argmax(axis=1)
            score = np.clip(mass[np.arange(hi - lo), best] / np.maximum(count, 1), 0.0, 1.0)
            yield batch.slice(lo, hi - lo), [crf.labels[b] if n and crf.labels else UNKNOWN for b, n in zip(best, count)], score


def labeller(crf: Crf):
    """(doc_id, held_out, text) to doc_id, held_out, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pred, score in labelled(crf, batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, crf: Crf, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(labeller(crf), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def filterer(crf: Crf, text: int, least: float):
    """The rows with a language and a score of at least ``least``, slice by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pred, score in labelled(crf, batches, text):
            yield part.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, crf: Crf, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``; nothing is shuffled, the text is sent once."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(filterer(crf, docs.columns.index(text), least), docs.schema)
