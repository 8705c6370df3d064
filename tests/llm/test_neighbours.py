import numpy as np
import pytest

from lodestar.llm import neighbours as N


def brute(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in good]
    links, root = dict.fromkeys((i for i, _ in rows), 0), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(good):
        for j, y in good[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert len(set(ids)) == len(ids)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in N.near_duplicate_vectors(df, **options).collect()}


@pytest.mark.parametrize("dim", [2, 5, 24])
def test_all_links_are_found(spark, dim, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 8)
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(9, dim))
    x = np.concatenate([centres[rng.integers(0, 9, 150)] + rng.normal(size=(150, dim)) * rng.choice([0.02, 0.15, 0.6], (150, 1)), centres[:3].repeat(4, axis=0)])
    rows = [(int(k), v) for k, v in zip(rng.permutation(len(x)) * 2, (x * rng.choice([0.1, 1, 50], (len(x), 1))).tolist(), strict=True)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-200, 0.0]), (10, [1e200, 1e190]), (11, [1.0]), (12, [0.0, 1.0])]
    got = run(spark, rows)
    assert {k: v for k, v in got.items() if k not in (7, 8, 9, 10)} == {k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 11, 12)}
    assert [got[k] for k in (7, 8, 9, 10)] == [(3, 7, True), (3, 7, False), (3, 7, False), (3, 7, False)]


def test_threshold_is_inclusive(spark):
    # 0.6 exactly
    assert run(spark, [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [0.59, 1.0])], cosine=0.6)[2][0] == 2


def test_empty_single_and_repeated(spark):
    assert run(spark, []) == {}
    assert run(spark, [(4, [1.0, 2.0])]) == {4: (0, 4, True)}
    df = spark.createDataFrame([(1, [1.0, 2.0], 3), (1, [1.0, 2.0], 4), (None, [1.0, 2.0], 5)], "vec_id long, embedding array<double>, n_links long")
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in N.near_duplicate_vectors(df).collect())
    assert got == [("1", 1, 1), ("1", 1, 1), ("None", 0, None)]
