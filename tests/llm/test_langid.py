import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fourfold.llm import langid
from fourfold.llm.langid import Crf, keep_identified, labelled, learn, predict, train, words_of


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(0)
    crf = Crf(["a", "b", "c"], {}, np.zeros((0, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([5, 1, 3])
    scores = rng.normal(size=(9, 3)) * 2
    got, at = crf.posteriors(scores, lengths), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = np.exp(crf.start[y[0]] + sum(scores[at + i, k] for i, k in enumerate(y)) + sum(crf.transitions[a, b] for a, b in zip(y, y[1:])))
            for i, k in enumerate(y):
                want[i, k] += p
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_chunks_do_not_change_posteriors(monkeypatch):
    rng = np.random.default_rng(1)
    crf = Crf(["a", "b"], {}, np.zeros((0, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    scores, lengths = rng.normal(size=(1000, 2)) * 3, np.array([1, 700, 0, 64, 235])
    want = crf.posteriors(scores, lengths)
    for size in (1, 7, 2000):
        monkeypatch.setattr(langid, "_CHUNK", size)
        for few in (0, 16):  # messages passed from chunk to chunk, transfer matrices
            monkeypatch.setattr(langid, "_FEW", few)
            assert np.allclose(crf.posteriors(scores, lengths), want)


def test_code_switching_is_followed():
    en, de = "the cat and the dog ran over this bridge with that", "der hund und die katze liefen nicht auf einer brücke"
    crf = train([("en", en)] * 5 + [("de", de)] * 5)
    words = en.split() + de.split()
    labels = [crf.labels[i] for i in crf.posteriors(crf.emissions(words), np.array([len(words)])).argmax(1)]
    assert labels == ["en"] * len(en.split()) + ["de"] * len(de.split())


def test_cases(spark):
    en, de = "the cat and the dog ran", "der hund und die katze lief"
    rows = [(i, (en, de)[i % 2], ("en", "de")[i % 2], 0.5) for i in range(40)]
    rows += [(100, None, "en", 1.0), (101, "", "de", 1.0), (102, "12 … €!", None, 1.0), (103, "THE CAT", None, 1.0), (None, de * 500, "de", 1.0), (0, en, "en", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    got = predict(df, learn(df)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: (r.lang_pred, r.held_out) for r in got}
    assert [by[i][0] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert all(h == (zlib.crc32(str(d if d is not None else "").encode()) % 4 == 2) for d, (_, h) in by.items())
    assert {r.lang_pred for r in predict(df, learn(df.where("false"))).collect()} == {"und"}
    assert predict(df.limit(0), learn(df)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    got = [r for r in predict(df, learn(df)).collect() if r.held_out]
    assert len(got) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.98


def test_every_label_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda i: " ".join(letters[i // 26] + letters[i % 26] + x for x in ("qo", "wu", "ka"))
    df = spark.createDataFrame([(100 * i + j, own(i), f"l{i:02d}") for i in range(70) for j in range(8)], "doc_id long, text string, lang string")
    crf = learn(df)
    assert len(crf.labels) == 70
    assert all(r.lang_pred == f"l{r.doc_id // 100:02d}" for r in predict(df, crf).collect())


def test_slices_do_not_change_training(monkeypatch):
    samples = [("en", "the cat and the dog ran over this bridge"), ("de", "der hund und die katze liefen nicht"), ("fr", "le chat et le chien")] * 4
    want = train(samples, steps=10)
    monkeypatch.setattr(langid, "_CELLS", 100)
    got = train(samples, steps=10)
    assert np.allclose(got.weights, want.weights) and np.allclose(got.transitions, want.transitions) and np.allclose(got.start, want.start)


def test_training_and_prediction_split_alike(spark):
    """Quotes and dashes beside letters change no word; a language of one-word texts is learned; clashing names are carried."""
    assert words_of("“The—cat’s” 12a_b é́ …") == ["thecats", "a", "b", "é"]
    rows = [(i, ("salve", "the cat ran")[i % 2], ("la", "en")[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = learn(df)
    ask = spark.createDataFrame([(1, "“Salve”", 2, 3), (2, "the—cat!", 4, 5), (3, "—", 6, 7), (4, None, 8, 9)], "doc_id long, text string, lang_pred int, held_out int")
    assert [r.lang_pred for r in predict(ask, crf).orderBy("doc_id").collect()][0::2] == ["la", "und"]
    kept = keep_identified(ask, crf, least=0.5)
    assert kept.columns == ask.columns and {tuple(r) for r in kept.collect()} >= {(1, "“Salve”", 2, 3)} and all(r.doc_id < 3 for r in kept.collect())


def test_small_word_table_changes_nothing(spark, monkeypatch):
    en, de = "the cat and the dog ran over", "der hund und die katze lief"
    crf = train([("en", en)] * 5 + [("de", de)] * 5)
    texts = pa.array([f"{(en, de)[i % 2]} x{'abcdefghij'[i % 10] * (i % 7)}" for i in range(300)] + [None, ""])
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    want = [(p, s.round(9).tolist()) for _, p, s in labelled(crf, iter([batch]), 0)]
    monkeypatch.setattr(langid, "_CACHE_BYTES", 160 * 8)
    monkeypatch.setattr(langid, "_SLICE", 200)
    got = [(p, s.round(9).tolist()) for _, p, s in labelled(crf, iter([batch]), 0)]
    assert len(got) > 10 and [sum(x, []) for x in zip(*got)] == [sum(x, []) for x in zip(*want)]


def test_ties_take_the_first_label(spark):
    crf = Crf(["a", "b"], {}, np.zeros((0, 2)), np.zeros((2, 2)), np.zeros(2))
    df = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in predict(df, crf).collect()] == [("a", 0.5)]
