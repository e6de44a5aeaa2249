import hashlib
import re

import numpy as np
import pytest

from fourfold.llm.kernels import Words
from fourfold.llm.substrings import Subtrees, remove_repeats, symbols


def brute(rows, span):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - span + 1):
            g, key = tuple(w[i : i + span]), float("inf") if d is None else d
            first[g] = min(first.get(g, key), key)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - span + 1):
            if (float("inf") if d is None else d) > first[tuple(w[i : i + span])]:
                gone |= set(range(i, i + span))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_subtrees_match_brute_force():
    """Order of the leaves, deep nodes and their depths against a sort of word lists."""
    rng = np.random.default_rng(5)
    runs = [[["a", "b", "ab", "é", "b" * 9][i] for i in rng.choice(5, int(rng.integers(0, 40)), p=[0.7, 0.2, 0.04, 0.03, 0.03])] for _ in range(40)]
    group = np.sort(rng.integers(0, 4, len(runs)))
    raw = [("  ".join(r)).encode() for r in runs]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for span in (1, 4, 6, 7):
        tree = Subtrees(Words(np.frombuffer(b"".join(raw), np.uint8), offsets, False), group, span)
        leaves = [(group[i], [w.encode() for w in r[p : p + span]], i, p) for i, r in enumerate(runs) for p in range(len(r) - span + 1)]
        assert [(group[tree.row[i]], tree.row[i], tree.place[i]) for i in tree.order] == [(g, i, p) for g, _, i, p in sorted(leaves)]
        edges = np.append(tree.node, len(tree.order))
        nodes = [[(tree.row[i], tree.place[i]) for i in tree.order[a:z]] for a, z in zip(edges, edges[1:])]
        want = {}
        for g, w, i, p in sorted(leaves):
            want.setdefault((g, *w), []).append((i, p))
        assert nodes == list(want.values())
        for leaves_, depth in zip(nodes, tree.depth):
            if len(leaves_) > 1:
                texts = [runs[i][p:] for i, p in leaves_]
                assert depth == max(n for n in range(len(min(texts, key=len)) + 1) if all(t[:n] == texts[0][:n] for t in texts))


def test_words_of_one_hash_are_told_apart(monkeypatch):
    words = Words(np.frombuffer(b"x yy x zz yy", np.uint8), np.array([0, 12]), False)
    want = symbols(words).tolist()
    monkeypatch.setattr(Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    assert symbols(words).tolist() == want == [1, 2, 1, 3, 2]


@pytest.mark.parametrize("group_rows", [100_000, 2])
def test_matches_brute_force(spark, group_rows):
    rng = np.random.default_rng(3)
    vocab = ["a", "b", "c", "é", "Ab"]
    words = lambda n: [str(x) for x in rng.choice(vocab, n)]
    shared = [words(30) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = words(int(rng.integers(0, 25)))
        for _ in range(int(rng.integers(0, 3))):
            parts += shared[int(rng.integers(4))] + words(int(rng.integers(0, 9)))
        rows.append((i, "\t".join(parts) if i % 7 else "  ".join(parts) + "\n"))
    rows += [(200 + i, rows[3][1]) for i in range(5)] + [rows[5], rows[9], (None, rows[8][1]), (None, rows[8][1]), (300, None), (301, ""), (302, " \x0b\x0c "), (303, "x " * 500), (304, "x " * 40)]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, ord int, node string").repartition(7)
    got = remove_repeats(df, span=12, gram=4, group_rows=group_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 12)


def test_kept_text_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "x a b c d e y")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in remove_repeats(df, span=4, gram=2, with_text=True).collect()} == {1: "a b c d e f", 2: "x y"}
    assert remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [100_000, 2])
def test_rows_of_one_id_keep_to_their_own_stretches(spark, group_rows):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one, two = words("one", 20), words("two", 30)
    rows = [(1, one), (2, two)]
    rows += [(d, t) for d in (7, None) for t in (f"{one} {words(f'a{d}', 60)}", f"{words(f'b{d}', 70)}", f"{words(f'c{d}', 40)} {two} z")]
    rows += [(None, f"{one} {words('many', 9)} {i}") for i in range(40)] + [rows[2], rows[6], rows[6], (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, span=12, gram=4, group_rows=group_rows)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 12)


def test_ids_of_other_types_and_split_parts(spark):
    """Text ids are compared as text; runs that no group holds alone (one document, thousands of equal words) are cut up."""
    line = " ".join(f"w{i}" for i in range(15))
    rows = [("10", f"{line} a"), ("9", f"b {line}"), ("x", "y " * 900), ("z", "y " * 700 + line), (None, f"{line} c"), ("9", f"d {line}")]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(2)
    for group_rows in (1, 1000):
        got = {(r.doc_id, r.n_words): r.n_removed for r in remove_repeats(df, span=12, gram=4, group_rows=group_rows).collect()}
        assert got == {("10", 16): 0, ("9", 16): 15, ("x", 900): 0, ("z", 715): 715, (None, 16): 15}
