import itertools
import re
from collections import Counter

import numpy as np
import pytest

from fourfold.llm import neardedup
from fourfold.llm.neardedup import bagminhash, near_duplicates, similarities


def bag(text, size=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def jaccard(a, b):
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 0.0


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if rows[i][1] is None or rows[j][1] is None:
            continue
        if rows[i][1] == rows[j][1] or jaccard(bags[i], bags[j]) >= 0.8:
            root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted((d, min(x for x in groups[find(i)])) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("weights", [(1, 1), (3, 5), (7, 2), (12, 16)])
def test_signature_is_unbiased(weights):
    rng = np.random.default_rng(5)
    n, m, trials = 30, 64, 60
    hits = []
    for _ in range(trials):
        e = rng.integers(0, 2**63, n).astype(np.uint64)
        wa, wb = (np.where(np.arange(n) < 20, w, 1 + np.arange(n) % 3) for w in weights)
        rows = np.repeat([0, 1], n)
        s = bagminhash(rows, np.concatenate([e, e]), np.concatenate([wa, wb]), 2, m)
        hits.append((s[0] == s[1]).mean())
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(np.mean(hits) - want) < 4 * np.sqrt(max(want * (1 - want), 1e-9) / (m * trials)) + 1e-9


def test_similarity_matches_counters():
    import pyarrow as pa

    a = ["a b c d e f g", "x", "", "r r r r r r r r", "Ä b c d é f"]
    b = ["A, b c d e f h", "x", "", "r r r r r r", "Ä b c d é f"]
    got = similarities(pa.array(a), pa.array(b), 5)
    assert np.allclose(got, [jaccard(bag(x), bag(y)) for x, y in zip(a, b)])


@pytest.mark.parametrize("small, block", [(64, 2_000_000), (2, 2_000_000), (2, 400)])
def test_groups_match_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardedup, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = list(rng.choice(vocab, int(rng.integers(20, 160))))
        rows.append((len(rows), " ".join(base)))
        for _ in range(int(rng.integers(0, 6))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(w)))
    base = list(rng.choice(vocab, 120))
    for i in range(60):  # copies that are near the original rather than each other
        w = list(base)
        for _ in range(int(rng.integers(2, 5)) if i else 0):
            w[int(rng.integers(120))] = f"new{i}"
        rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, None), (1002, ""), (1003, ""), (1004, "!!"), (1005, "one"), (1006, "ONE"), (1007, "a b c d"), (1008, "a b c d"), (1009, "la " * 3000), (1010, "la " * 3100)]
    rows += [rows[0], rows[3]]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, node string, label string").repartition(5)
    got = sorted((r.doc_id, r.group_id) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
