"""Periodic runs against a brute-force search over all periods."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import queries, runs


def brute(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                stretch = words[i : j + q]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, j - i + q, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def hashed(words: list[int]) -> np.ndarray:
    return np.array([w * 0x9E3779B97F4A7C15 % (1 << 64) for w in words], np.uint64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), max_size=4), st.sampled_from([4, 6, 12]))
def test_all_runs_of_small_alphabets(docs, least):
    flat = hashed([w for d in docs for w in d])
    found = runs.find_runs(flat, np.array([len(d) for d in docs], np.int64), least)
    assert {k: r for k, d in enumerate(docs) if (r := brute(d, least))} == found


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=5), st.integers(1, 12)), max_size=8))
def test_runs_of_repeated_pieces(parts):
    words = [w for piece, times in parts for w in piece * times]
    found = runs.find_runs(hashed(words), np.array([len(words)]))
    assert found.get(0, []) == brute(words)


def test_a_run_within_a_run_and_fibonacci_words():
    a, b = [1], [1, 2]
    while len(b) < 400:
        a, b = b, b + a
    assert runs.find_runs(hashed(b), np.array([len(b)]))[0] == brute(b)


EDGES = [
    (0, None), (1, ""), (2, " \t\n\r\x0b\x0c "), (3, "x " * 11), (4, "x " * 12), (5, "a b c " * 4), (6, "a b c " * 4), (6, "a b c " * 4),
    (7, "A a " * 9), (8, "    " * 9), (9, "p q r s t u v w " + "Zwei Wörter " * 20 + "Ende"), (None, "n m " * 30), (None, None),
    (10, "one two three four five six seven eight nine ten eleven twelve"), (-7, "y\x00 z " * 10),
    *((k, " ".join(str(j * j % 97) for j in range(k))) for k in range(20, 80)),
]


def test_edges_against_brute_force(spark):
    docs = spark.createDataFrame([(d, t, k, "c") for k, (d, t) in enumerate(EDGES)], "doc_id long, text string, runs int, start string")
    got = [tuple(r) for r in runs.digests(runs.periodic_runs(docs, edited=True)).collect()]
    assert sorted(map(repr, got)) == sorted(repr(expected(d, t)) for d, t in EDGES)
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in EDGES)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    n = 200_000
    texts = [(1, "a " * n), (2, " ".join(str(k % 70_001) for k in range(n))), (3, "b" * 5_000_000), (4, " " * 5_000_000), (5, " ".join(map(str, range(n))))]
    found = {r.doc_id: r for r in runs.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in found[1].runs] == [(0, n, 1)]
    assert found[1].collapsed == "a"
    assert [tuple(r) for r in found[2].runs] == [(0, n, 70_001)]
    assert not any(found[k].runs for k in (3, 4, 5))


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_against_brute_force(spark, name):
    folder = f"/root/testdata/{name}"
    docs = queries.table(spark, folder, "documents").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len((r.text or "").split()) <= 1500}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert len(got) == len(docs)
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in docs if r.doc_id in short)
    assert len(short) > 150
