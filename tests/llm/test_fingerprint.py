import hashlib
import math
from collections import Counter

import numpy as np

from fourfold.llm.fingerprint import CUT_OFF, FILTER_BITS, HASHES, LEAST, PER_FILTER, POPULAR, SCALE, WINDOW, decode, digest, encode, entropies, features, fingerprint_chain, likeness
from fourfold.llm.kernels import mix64


def test_entropies_match_counting():
    rng = np.random.default_rng(1)
    data = rng.choice(np.frombuffer(b"aaabcde fghij\xc3\xa9", np.uint8), 400)
    want = []
    for i in range(len(data) - WINDOW + 1):
        h = -sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(data[i : i + WINDOW].tolist()).values())
        want.append(min(SCALE - 1, int(h / math.log2(WINDOW) * (SCALE - 1e-6))))
    assert np.abs(entropies(data) - want).max() <= 1  # rounding at a step of the scale


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        out.append((d, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_chain_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    alphabet = list("abcdeé ßfg\n𝄞h")
    rows = [(int(i) * 3, "".join(rng.choice(alphabet, int(rng.integers(0, 900))))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "x" * 5000), (503, "ab"), (None, "null id"), (None, "other null id"), rows[7]]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, part int, o int").repartition(6)
    got = fingerprint_chain(df, rows_per_range=10).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute(rows)
    text, prints = dict(rows), {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id is not None:
            assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 300 and r.doc_id != 502]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.3
    one = fingerprint_chain(df.limit(0).union(spark.createDataFrame([(9, "lone", 1, 1)], df.schema))).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(9, 1.0)]
    assert fingerprint_chain(df.limit(0)).count() == 0


def by_hand(raw, ranks):
    """The digest of one text, window by window: features, filters and their bits."""
    windows = [raw[i : i + WINDOW] for i in range(len(raw) - WINDOW + 1)]
    rank = []
    for w in windows:
        value = entropies(np.frombuffer(w, np.uint8))[0]
        rank.append(len(ranks) if value < LEAST else int(ranks[value]))
    run = min(WINDOW, len(windows))
    wins = Counter(min(range(i, i + run), key=lambda j: (rank[j], j)) for i in range(len(windows) - run + 1)) if windows else {}
    need = min(POPULAR, len(windows) - run + 1)
    found = [windows[i] for i in sorted(wins) if wins[i] >= need and rank[i] < len(ranks)]
    hashes = [int(mixed([w])[0]) for w in found] if found else [int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")] if raw else []
    filters = []
    for i, h in enumerate(hashes):
        if i % PER_FILTER == 0:
            filters.append(set())
        h = int(mix64(np.array([h], np.uint64))[0])
        filters[-1] |= {(h >> 20 * j) % FILTER_BITS for j in range(HASHES)}
    return filters


def mixed(windows):
    """The hash of a window's eight words."""
    out = np.zeros(len(windows), np.uint64)
    for j in range(WINDOW // 8):
        out = mix64(out ^ np.array([int.from_bytes(w[8 * j : 8 * j + 8], "little") for w in windows], np.uint64)) + np.uint64(j)
    return out


def alike(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    out = []
    for x in a:
        best = 0.0
        for y in b:
            most, chance = min(len(x), len(y)), len(x) * len(y) / FILTER_BITS
            floor = chance + CUT_OFF * (most - chance)
            best = max(best, (len(x & y) - floor) / (most - floor) if len(x & y) > floor else 0.0)
        out.append(best)
    return min(1.0, sum(out) / len(out))


def test_fingerprints_and_likenesses_match_brute_force(spark):
    """Every column of the query against a version that goes window by window, document by document; ties and texts near a window's length too."""
    rng = np.random.default_rng(8)
    words = ["the", "of", "Größe", "x1", "aa", "\n", "été", "zz;", "word", "it"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 130)))) for _ in range(25)] + ["a" * 63, "b" * 64, "c d " * 16, "e" * 65, "q" * 300, "", None]
    texts += [texts[3] + " end", texts[4], texts[4]]
    rows = [(i % 31, t) for i, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    counts = Counter()
    for t in texts + ["no id"]:
        raw = (t or "").encode()
        counts.update(int(entropies(np.frombuffer(raw[i : i + WINDOW], np.uint8))[0]) for i in range(len(raw) - WINDOW + 1))
    ranks = {v: i for i, v in enumerate(sorted(range(SCALE), key=lambda v: (counts[v], v)))}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest() if r[1] is not None else ""))
    want = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 3
        mine, edited, other = (by_hand(x.encode(), ranks) for x in (t, t[: len(t) - k] + nxt[:k], nxt))
        want.append((d, mine, edited, round(alike(mine, edited), 5), round(alike(mine, other), 5)))
    bits = lambda text: [set(np.flatnonzero(f).tolist()) for f in decode(text)]
    got = [(r.doc_id, bits(r.fingerprint), bits(r.edited_fingerprint), round(r.near_edited, 5), round(r.near_next, 5)) for r in fingerprint_chain(df, rows_per_range=7).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_ids_that_are_text(spark):
    rows = [("b", "one text here"), ("a", "two"), ("ab", "three words"), ("", "none"), ("é", "four"), (None, "five"), ("ba", "six"), ("bb" * 9, "seven")] + [(f"z{i:03d}", f"t {i}") for i in range(40)]
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()), reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        k = len(t) // 3
        want[d] = hashlib.sha256((t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]).encode()).hexdigest()
    got = fingerprint_chain(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), rows_per_range=6).collect()
    assert {r.doc_id: r.edited_sha256 for r in got} == want


def test_digest_round_trip():
    data = np.random.default_rng(0).integers(32, 127, 40_000).astype(np.uint8)
    d = digest(features(data, entropies(data), np.arange(SCALE)))
    assert len(d) > 1 and (decode(encode(d)) == d).all() and likeness(d, d) == 1.0
