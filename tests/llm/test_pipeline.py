import hashlib
import math
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from fourfold.llm import langid, sharding
from fourfold.llm.mixing import BLOCK, FINENESS, lattice
from test_native_ops import alnum, water_fill
from test_neardedup import brute as groups_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@needs_data
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_000, None, "en", "src1", 0), (90_001, "123 ... 456", "en", "src1", 11), (90_002, "", None, None, 0)]
    copy = docs.where("n_chars > 800").orderBy("doc_id").first()
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    extra += [(90_003, copy.text, copy.lang, copy.source, copy.n_chars), (90_004, docs.where("n_chars > 300").orderBy("doc_id").first().text + " " + leak, "en", "src2", 5)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    ids = {}
    for name, stage in pipeline.STAGES:
        stage(spark, rows, SF).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.columns[: len(docs.columns)] == docs.columns and (name == "shard") == (len(rows.columns) > len(docs.columns))
        ids[name] = Counter(r.doc_id for r in rows.select("doc_id").collect())
    assert not {90_000, 90_001, 90_002} & set(ids["language_id"]) and len(ids["language_id"]) == docs.count() + 2
    assert 90_003 not in ids["near_dedup"] and copy.doc_id in ids["near_dedup"]
    assert 90_004 not in ids["decontamination"] and set(ids["decontamination"]) <= set(ids["near_dedup"])
    assert max(ids["mixture"].values()) <= 3 and ids["shard"] == ids["mixture"]
    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)], sharding.SLOTS)
    assert all(r.shard == table[r.slot] for r in rows.select("slot", "shard").collect())


def test_short_items_do_not_condemn_alone(spark, tmp_path):
    eight = "one two three four five six seven eight"
    items = [(1, "yes"), (2, "42"), (3, eight), (None, "maybe"), (2, "a b")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["yes it is", "the 42 and a b", "yes 42", f"x {eight} y", "nothing", eight[:-6], "maybe yes", "maybe", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [0, 1, 4, 5, 7, 8]


def corpus():
    """Rows (doc_id, text, lang, source) with copies, near copies, leaks, junk, nulls, repeated rows and one long text."""
    rng = np.random.default_rng(21)
    en = "the and of to in that it was for on are as with they at be this from have or one had by word but not what all were we when your can said there use each which do how their if".split()
    de = "der und die das ist nicht ein eine mit auf den sich des dem zu von auch werden bei haben noch nach wie einer um am sind aber oder wenn nur man aus durch kann dann".split()
    say = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, say((en, de)[i % 2], int(rng.integers(20, 160))), ("en", "de")[i % 2], f"s{i % 4}") for i in range(120)]
    item = say(en, 30)
    for i in range(6):
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows += [(300 + i, " ".join(w) if len(w) > 60 else rows[i][1], rows[i][2], "s1"), (400 + i, rows[10 + i][1], None, None)]
        rows.append((500 + i, f"{say(en, 20)} {' '.join(item.split()[i : i + 8 + i])} {say(en, 20)}", "en", "s2"))
    rows += [(600, None, "en", "s0"), (601, "", None, "s0"), (602, "12 34 !?", "de", None), (603, say(de, 30_000), "de", "s3"), rows[7], rows[7], (None, say(en, 90), "en", "s9"), (None, say(de, 80), "de", None)]
    return rows, [(1, item), (2, say(de, 12)), (3, "yes"), (None, "no")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.5) for r in rows], "doc_id long, text string, lang string, source string, size int, group_id string, lang_pred double").repartition(5)


def ids(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def taken(rows):
    """The words that the mix takes of each row, row by row."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    of = Counter()
    for (_, _, _, source), n in zip(rows, sizes):
        of[source] += n
    target = water_fill(of)
    share = {s: math.floor(t + 0.5) for s, t in target.items()}
    block = {s: max([1] + [1 << k for k in range(1, BLOCK.bit_length()) if t >= FINENESS << k]) for s, t in target.items()}
    names, turns = sorted(of, key=lambda s: (s is None, s)), Counter()
    for b in set(block.values()):
        mine = [s for s in names if block[s] == b and share[s]]
        total = sum(share[s] for s in mine)
        if not total:
            continue
        n, rank = max(1, (total + b // 2) // b), Counter()
        step, ends = lattice(n), np.cumsum([share[s] for s in mine])
        for t in range(n):
            s = mine[int(np.searchsorted(ends, ((t * step % n) * total + total // 2) // n, "right"))]
            blocks = -(-of[s] // b)
            if rank[s] < 3 * blocks:
                turns[s, rank[s] % blocks] += 1
            rank[s] += 1
    order = sorted(range(len(rows)), key=lambda i: (sharding.digest60("null" if rows[i][0] is None else str(rows[i][0])), sizes[i], int(hashlib.md5((rows[i][1] or "").encode()).hexdigest()[:15], 16)))
    at, out = Counter(), [0] * len(rows)
    for i in order:
        s, b = rows[i][3], block[rows[i][3]]
        lo, hi = at[s], at[s] + sizes[i]
        at[s] = hi
        out[i] = sum((min(hi, (k + 1) * b) - max(lo, k * b)) * turns[s, k] for k in range(lo // b, -(-hi // b))) if hi > lo else 0
    return sizes, out


def test_each_stage_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = frame(spark, rows)
    sf = str(tmp_path)

    crf = langid.learn(df)
    kept = pipeline.language_id(spark, df, sf)
    said = {t: next((p, float(s[0])) for _, (p,), s in langid.labelled(crf, iter([pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["t"])]), 0)) for t in {t for _, t, _, _ in rows}}
    want = Counter((d, t) for d, t, _, _ in rows if said[t][0] != "und" and said[t][1] >= pipeline.LEAST_SCORE)
    assert ids(kept) == want and kept.columns == df.columns and not any(t in (None, "", "12 34 !?") for _, t in want)

    got = ids(pipeline.near_dedup(spark, df, sf))
    least = dict.fromkeys(g for _, g in groups_of([(10**6 if d is None else d, t) for d, t, _, _ in rows if t is not None]))
    assert {10**6 if d is None else d for d, t in got if t is not None} == set(least)
    assert max(v for (d, t), v in got.items() if t is not None) == 1 and got[600, None] == 1

    def leaks(text):
        w, hit = alnum(text), Counter()
        for item, t in items:
            u = alnum(t)
            k = min(8, len(u))
            if any(w[i : i + k] == u[j : j + k] for i in range(len(w) - k + 1) for j in range(len(u) - k + 1)):
                hit[item] = k
        return max(hit.values(), default=0) >= 8 or len(hit) >= 2

    clean = [r for r in rows if not leaks(r[1])]
    assert ids(pipeline.decontamination(spark, df, sf)) == Counter((d, t) for d, t, _, _ in clean) and len(clean) < len(rows) - 4

    sizes, words = taken(rows)
    times = Counter()
    for r, n, w in zip(rows, sizes, words):
        times[r[0], r[1]] += math.floor(w / n + 0.5) if n else 0
    mixed = pipeline.mixture(spark, df, sf)
    assert ids(mixed) == +times and mixed.columns == df.columns

    table = sharding.lookup_table([f"shard-{i}" for i in range(sharding.SHARDS)], sharding.SLOTS)
    placed = pipeline.shard(spark, df, sf)
    assert placed.count() == len(rows) and all(r.shard == table[sharding.digest60("null" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS] for r in placed.collect())


def test_empty_tables(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = frame(spark, rows)
    for name, stage in pipeline.STAGES:
        none = stage(spark, df.limit(0), str(tmp_path))
        assert none.columns[: len(df.columns)] == df.columns and none.count() == 0, name
    assert ids(pipeline.decontamination(spark, df, str(tmp_path))) == Counter((d, t) for d, t, _, _ in rows)


def test_run_leaves_the_last_stage_only(spark, tmp_path):
    rows, items = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    at = os.path.dirname(os.path.dirname(out.inputFiles()[0].removeprefix("file:")))
    assert out.count() > 50 and os.listdir(at) == ["4-shard"]
