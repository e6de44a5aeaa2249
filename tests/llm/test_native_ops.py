import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourfold.llm import licenses
from fourfold.llm.decontaminate import decontaminate
from fourfold.llm.licenses import TEMPLATES, scan
from fourfold.llm.mixing import mix, source_targets
from fourfold.llm.sharding import assign_shards, digest60, lookup_table


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# Decontamination.
def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = ["a", "b", "c", "d", "É", "x1"]
    words = lambda n: [str(x) for x in rng.choice(vocab, n)]
    items = [(i, " ".join(words(int(n)))) for i, n in enumerate([12, 30, 8, 9, 3, 4, 7, 1, 15, 20])] + [(20, None), (21, "..."), (None, "b É É x1 a d c b a"), (3, "a a a a b b b b c")]
    docs = []
    for i in range(70):
        w = words(int(rng.integers(0, 40)))
        if i % 3 == 0:
            w += alnum(items[i % 10][1])[: int(rng.integers(5, 31))]
        docs.append((i, "; ".join(w + words(3)).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(100, None), (101, ""), docs[3], docs[6], (None, items[1][1]), (None, items[1][1]), (102, " ".join(alnum(items[1][1]) * 300))]

    def brute(text):
        w, hit, found = alnum(text), set(), set()
        for item, t in items:
            u = alnum(t)
            k = min(8, len(u))
            windows = {tuple(u[i : i + k]) for i in range(len(u) - k + 1)} if u else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
        return len(w), len(hit), sorted(found)

    df = spark.createDataFrame([(d, t, 1, "z") for d, t in docs], "doc_id long, text string, items int, n_words string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((d, *brute(t)) for d, t in docs), key=str)
    for limit in (32 << 20, 0):  # both joins
        got = decontaminate(df, bench, broadcast_bytes=limit).collect()
        assert sorted(((r.doc, r.n_words, r.n_hit, list(r.items)) for r in got), key=str) == want
    clean = decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.n_hit for r in clean)
    assert decontaminate(df.limit(0), bench).count() == 0


# Mixing.
def water_fill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        for s in list(open_):
            target[s] += share * weight[s]
        left = 0.0
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 3, "d": 0}, {"é": 5, None: 7, "Z": 500}, {"a": 0}, {f"s{i:02d}": 1 + 37 * i * i for i in range(20)}])
def test_targets_are_water_filling(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mix(spark):
    rng = np.random.default_rng(2)
    docs = [(i, "w " * int(rng.integers(0, 300)), f"s{min(9, int(rng.exponential(3)))}") for i in range(600)] + [(700, None, "s1"), (701, "a b", None), (702, "", "s2"), (5, "a b c", "s3"), (5, "a b c", "s3"), (None, "x y", "s0")]
    df = spark.createDataFrame([(d, t, s, 4) for d, t, s in docs], "doc_id long, text string, source string, size int").repartition(5)
    got = mix(df).collect()
    assert len(got) == len(docs) and Counter(r.doc_id for r in got) == Counter(d for d, _, _ in docs)
    size, sum_taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == 0 and r.taken == 0 or 0 <= r.taken <= 3 * r.size
    by = {(d, len((t or "").split())): s for d, t, s in docs}
    for r in got:
        s = by[r.doc_id, r.size]
        size[s] += r.size
        sum_taken[s] += r.taken
        target[s] = r.target
    want = water_fill({s: size[s] for s in size})
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(sum_taken[s] - target[s]) <= max(3, 0.03 * target[s])
    assert sorted(map(str, mix(df.repartition(2)).drop("rid").collect())) == sorted(map(str, (r for r in mix(df).drop("rid").collect())))
    assert mix(df.limit(0)).count() == 0


def test_small_sources_beside_large_ones_come_near_their_targets(spark):
    """Sources from 7 words to 4 million, among them one of 90 words and 400 of one document each."""
    docs = [(i, "w " * 40_000, "huge") for i in range(100)] + [(1000 + i, "w " * 30, "ninety") for i in range(3)] + [(2000, "a b c d e f g", None)]
    docs += [(3000 + i, "x " * (5 + 3 * i), f"host{i:03d}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = mix(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source", "target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 403
    for r in got:
        assert abs(r.taken - r.target) <= max(1, 0.02 * r.target) and r.taken <= 3 * r.source_size, r


def test_equal_ids_with_unlike_texts_do_not_depend_on_partitions(spark):
    docs = [(1, f"{c} " * 200, "s") for c in "abcdefgh"] + [(2, "z " * 5000, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    seen = {str(sorted((r.doc_id, r.text_hash, r.taken) for r in mix(df.repartition(n)).collect())) for n in (1, 3, 7)}
    assert len(seen) == 1


def test_lattice_meets_every_point():
    from fourfold.llm.mixing import lattice

    for n in (*range(1, 200), 6765, 30030, 1 << 20):
        s = lattice(n)
        assert math.gcd(s, n) == 1 and (n < 50 or abs(s / n - 0.618034) < 0.1)


# Sharding.
def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = lookup_table(names, 101)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = lookup_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 40
    for bad in ((names, 100), ([], 101), (["a", "a"], 101), (names, 5)):
        with pytest.raises(ValueError):
            lookup_table(*bad)


def test_assign_shards(spark):
    df = spark.createDataFrame([(i % 50, "a", 1) for i in range(200)] + [(None, "b", 2)], "doc_id long, slot string, shard int")
    got = assign_shards(df, "doc_id", shards=["x", "y", "z"], slots=31)
    assert got.columns == ["doc_id", "slot", "shard", "slot_", "shard_"] and got.count() == 201
    table = lookup_table(["x", "y", "z"], 31)
    for r in got.collect():
        slot = digest60("null" if r.doc_id is None else str(r.doc_id)) % 31
        assert (r.slot_, r.shard_) == (slot, table[slot])


# Licenses.
def contained(words, template):
    u, k = alnum(template), 5
    grams = [tuple(u[i : i + k]) for i in range(len(u) - k + 1)]
    mine = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    slack = max(2, len(u) // 4)
    where = defaultdict(list)
    for i, g in enumerate(grams):
        where[g].append(i)
    shifts = {i - j for i, g in enumerate(mine) for j in where.get(g, ())}
    return max((len(set(grams) & set(mine[max(0, s - slack) : max(0, s + len(grams) + slack)])) / len(set(grams)) for s in shifts), default=0.0)


@pytest.mark.parametrize("known", [20_000, 0])  # texts looked up first, or all through their windows
def test_licenses_match_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(licenses, "KNOWN", known)
    rng = np.random.default_rng(3)
    filler = lambda n: [f"v{int(x)}" for x in rng.integers(0, 50, n)]
    docs = []
    for i in range(60):
        name, text = TEMPLATES[i % len(TEMPLATES)]
        w = text.split()
        for _ in range(int(rng.integers(0, 3)) if len(w) > 20 else 0):
            w[int(rng.integers(len(w)))] = "changed"
        docs.append((i, " ".join(filler(int(rng.integers(0, 60))) + w + filler(int(rng.integers(0, 60))))))
    docs += [(100, None), (101, "one two"), (102, " ".join(filler(4000))), docs[0], docs[1], (None, TEMPLATES[0][1])]
    df = spark.createDataFrame([(d, t, "q") for d, t in docs], "doc_id long, text string, matches string").repartition(3)
    got = sorted((str(r.doc), r.n_words, [(m.tid, round(m.containment, 9)) for m in r.matches]) for r in scan(df).collect())
    want = sorted((str(d), len(alnum(t)), sorted(((i, round(c, 9)) for i, (_, x) in enumerate(TEMPLATES) if (c := contained(alnum(t), x)) >= 0.8), key=lambda m: (TEMPLATES[m[0]][0], m[0]))) for d, t in docs)
    assert got == want
    assert scan(df.limit(0)).count() == 0


def test_altered_notices_are_found(spark):
    """Recall against exact containment over notices with words changed, lost and added: all of those that keep four fifths of their shingles."""
    rng = np.random.default_rng(11)
    docs = []
    for i in range(1500):
        w = alnum(TEMPLATES[i % len(TEMPLATES)][1])
        for _ in range(int(rng.integers(0, 1 + len(w) // 20))):
            at, how = int(rng.integers(len(w))), rng.integers(3)
            w[at : at + (how != 2)] = [] if how == 1 else [f"zz{i}"]
        docs.append((i, " ".join(["before"] * (i % 9) + w + ["after"] * (i % 7))))
    want = {i for i, t in docs if contained(alnum(t), TEMPLATES[i % len(TEMPLATES)][1]) >= 0.8}
    got = {r.doc for r in scan(spark.createDataFrame(docs, "doc_id long, text string")).collect() if any(m.tid == r.doc % len(TEMPLATES) for m in r.matches)}
    assert len(want) > 1000 and got == want


def test_ties_of_place_tell_the_first(spark):
    notice = TEMPLATES[1][1]
    got = scan(spark.createDataFrame([(1, f"{notice} and again {notice}")], "doc_id long, text string")).first().matches
    assert [(m.tid, m.start, m.containment) for m in got] == [(1, 1, 1.0)]


# Hashes agree between columns and Python.
def test_key_hash(spark):
    from fourfold.llm.sharding import key_hash

    keys = [1, 2, -5, 10**15]
    got = [r.h for r in spark.createDataFrame([(k,) for k in keys], "k long").select(key_hash(F.col("k")).alias("h")).collect()]
    assert got == [digest60(str(k)) for k in keys] and digest60("1") == int(hashlib.md5(b"1").hexdigest()[:15], 16)
