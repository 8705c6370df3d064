import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import ngram_join, shared
from lodestar.llm.ngram_join import near_duplicate_components


def brute(rows, words=5):
    """(n_shingles, component) by doc_id of (doc_id, text) rows, by all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(df, **options).collect()}


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    rows = []
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        if rng.random() < 0.3:
            w = w + passage
        text = rng.choice([" ", "\t", "\n "]).join(w)
        rows.append((k * 3 + 1, text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("frequent", [1 << 18, 5, 0])
def test_all_links_are_found(spark, frequent):
    """With any number of frequent shingles, as the order may only change the work."""
    rows = corpus(frequent)
    assert run(spark, rows, frequent_most=frequent) == brute(rows)


@pytest.mark.parametrize("counters", [3, 40, 10_000])
def test_summaries_bound_their_error(counters):
    """Counts are never too high, and too low by 2 N / counters at most; a task hands on what stood twice in it."""
    rng = random.Random(counters)
    docs = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(300)) for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(docs[k : k + 7])], ["text"]) for k in range(0, 40, 7)]
    exact = {}
    for batch in batches:
        for _, s in shared.shingle_sets(batch.column(0), 1):
            for t in s.view("int64").tolist():
                exact[t] = exact.get(t, 0) + 1
    found = {}
    for batch in ngram_join._count_common(1, counters, 500)(iter(batches)):
        found.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    assert all(n <= exact[t] and exact[t] > 1 for t, n in found.items())
    off = 2 * sum(exact.values()) / counters
    assert all(exact[t] - found.get(t, 0) <= off for t in exact if exact[t] > 1)
    if counters == 10_000:
        assert found == {t: n for t, n in exact.items() if n > 1}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x" * 200_000), (8, "ab"), (9, "é É"), (10, "é é")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert got[5] == (1, 4) and got[1] == (0, 1) and got[10] == (1, 10)


def test_threshold_is_exact(spark):
    a = [f"t{k}" for k in range(16)]  # 12 shingles
    rows = [(1, " ".join(a)), (2, " ".join(a[:13])), (3, " ".join(a[:12])), (4, " ".join(a) + " " + " ".join(f"u{k}" for k in range(4)))]
    got = run(spark, rows)
    assert got[2] == (9, 1) and got[4] == (16, 1) and got[3] == (8, 1)
    assert got == brute(rows)


def test_null_repeated_and_extra_columns(spark):
    text = "one two three four five six"
    rows = [(None, text, 1, "x"), (5, text, 2, "y"), (5, text, 3, "z"), (9, text, 4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_components(df).collect()), key=str)
    assert got == [(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, None)]


def test_rows_of_one_id_with_different_texts(spark):
    """Each row is judged by its own text; a null or blank one beside it changes nothing."""
    texts = corpus(7, 80)
    rows = [(1000 - k // 3 if k % 2 else k, text) for k, (_, text) in enumerate(texts)]
    rows += [(d, t) for d, _ in rows[::4] for t in (None, " ", "a b")]
    by_row = brute(list(enumerate(t for _, t in rows)))
    first = {}
    for k, (d, _) in enumerate(rows):
        first[by_row[k][1]] = min(d, first.get(by_row[k][1], d))
    expected = sorted((d, by_row[k][0], first[by_row[k][1]]) for k, (d, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicate_components(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected


def test_empty_table(spark):
    assert near_duplicate_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_of_batches():
    texts = ["One two", None, "", "a\x0bb\x1cc", "é É  x"]
    hashes, counts = shared.word_hashes(*shared.text_bytes(pa.array(texts)))
    assert counts.tolist() == [2, 0, 0, 2, 2]
    again, _ = shared.word_hashes(*shared.text_bytes(pa.array(["ONE", "b\x1cc", "x"])))
    assert hashes[0] == again[0] and hashes[3] == again[1] and hashes[5] == again[2]


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 800), (800, 800)], "a long, b long"))
    found = {r.node: r.component for r in shared.connected_components(links, shared.shared_folder(spark)).collect()}
    assert found == {k: 0 for k in range(301)} | {800: 800, 900: 800}
