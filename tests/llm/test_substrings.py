"""Removed passages against a count of all windows."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import queries, substrings


def brute(rows, size=35):
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + size]) for _, w in texts for i in range(len(w) - size + 1))
    for doc_id, w in texts:
        gone = {k for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for k in range(i, i + size)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        yield doc_id, len(w), len(gone), sha256(kept).hexdigest()


def same(got, rows, size=35):
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute(rows, size)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=25), max_size=4), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40))
def test_matching_statistics(texts, words):
    automaton = substrings.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    known = {tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)}
    under = {k for i in range(len(words) - 2) if tuple(words[i : i + 3]) in known for k in range(i, i + 3)}
    found = automaton.covered(words, 3)
    assert {k for a, b in found for k in range(a, b)} == under
    assert all(b < c for (_, b), (c, _) in zip(found, found[1:], strict=False))


def test_equal_windows_have_equal_anchors_that_stand_twice():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    words[300:350] = words[20:70]
    words[100:160] = np.resize(words[100:103], 60)
    doc = np.repeat([0, 1], 200)
    starts, anchors, placed = substrings.window_anchors(words, doc, 35)
    assert starts.tolist() == [*range(166), *range(200, 366)]
    known = Counter(placed.tolist())
    by_window = {}
    for s, a in zip(starts.tolist(), anchors.tolist(), strict=True):
        by_window.setdefault(words[s : s + 35].tobytes(), []).append(a)
    assert all(len(set(a)) == 1 and (len(a) == 1 or known[a[0]] > 1) for a in by_window.values())
    assert sum(len(a) > 1 for a in by_window.values()) > 16


def corpus(seed, n=120):
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}w{j}" for j in range(rng.randint(8, 60))) for k in range(12)]
    rows = []
    for k in range(n):
        parts = [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages[: 1 + rng.randint(0, 11)]))
        rows.append((k, " ".join(parts)))
    rows += [(200 + k, rows[5][1]) for k in range(6)]
    words = rows[7][1].split()
    rows += [(300 + k, " ".join(words[: len(words) - k] + ["end"])) for k in range(20)]
    rows += [(400, " ".join(["a", "b"] * 40)), (401, "z " * 90), (402, " ".join(map(str, [*range(35), *range(36)])))]
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"chunk_words": 300, "shard_windows": 40, "range_hashes": 50, "salt_words": 200}), (3, {"bits": 8, "chunk_words": 1})])
def test_corpora_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, key string, chunk int").repartition(3)
    same(substrings.remove_repeated(df, **options), rows)
    same(substrings.remove_repeated(df, size=12, **options), rows, 12)


def test_edges(spark):
    words = [f"w{k}" for k in range(35)]
    rows = [
        (1, None), (2, ""), (3, " \t\x0b "), (None, " ".join(words)), (None, None), (4, "\n".join(words)), (4, " ".join(words)), (5, " ".join(words[:34])),
        (6, " ".join(words).upper()), (7, " ".join(f"x{k}" for k in range(35))), (-8, "é" * 40), (9, " ".join(["same"] * 35)), (10, " ".join(["twice"] * 36)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(substrings.remove_repeated(df), rows)
    assert substrings.remove_repeated(df.limit(0)).count() == 0
    same(substrings.remove_repeated(df.where("doc_id = 7")), [rows[9]])


def test_very_long_texts(spark):
    long_ = " ".join(f"q{k}" for k in range(120_000))
    rows = [(1, long_), (2, "new " + long_ + " end"), (3, "b" * 3_000_000), (4, " " * 3_000_000), (5, "a " * 200_000)]
    got = {r.doc_id: r for r in substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"), chunk_words=50_000).collect()}
    assert {k: (r.n_words, r.n_removed) for k, r in got.items()} == {1: (120_000, 120_000), 2: (120_002, 120_000), 3: (1, 0), 4: (0, 0), 5: (200_000, 200_000)}
    assert got[2].kept_sha256 == sha256(b"new end").hexdigest()


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()]
    same(queries.op13_substring_dedup(spark, "/root/testdata/sf0.001"), rows)
