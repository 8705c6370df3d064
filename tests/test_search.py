"""Coded cells against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import coded, graph, pruned, search
from lodestar.plans import catalog
from lodestar.session import stored


def rows_of(spark, seed, n=1500, width=24, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    x = (centres[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, width))).astype(np.float32)
    x[:40] = x[40:80]
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<float>")


@pytest.fixture(scope="module")
def vectors(spark):
    return rows_of(spark, 1).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("id % 60 = 0").select(F.col("id").alias("qid"), F.transform("vector", lambda x: x * 1.1 + 0.01).alias("vector")).cache()


def hits(df):
    return {(r.qid, r.rank): (r.id, pytest.approx(r.score, rel=1e-6, abs=1e-9)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_coded_cells_are_searched_exactly(vectors, asked, metric):
    centres = search.train_cells(vectors, 12)
    index = coded.build_coded_cells(vectors, centres).cache()
    for probes in (2, 12):
        got = hits(coded.search_coded_cells(index, asked, centres, 10, probes, metric))
        assert got == hits(search.knn_ivf(vectors, asked, centres, 10, probes, metric))
    assert got == hits(search.knn_exact(vectors, asked, 10, metric))
    wanted = coded.coded_candidates(index, asked, centres, 10, 12, metric).count()
    assert wanted < 0.1 * vectors.count() * asked.count()


def test_codes_are_within_half_a_step():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 9)) * [1e-3, 1, 1e3, 0, 5, 1, 1, 1, 1] + [0, 1e3, 0, 7, 0, 0, 0, 0, 0]
    low, step, codes = coded.encode(x)
    back = low.astype(float) + codes * step.astype(float)
    assert (np.abs(back - x) <= step * 0.501 + np.abs(low) * 1e-7).all()


def test_edges_of_coded_cells(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [-1.0, 0.0])]
    docs = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "qid long, vector array<float>")
    centres = search.train_cells(docs, 2)
    for metric in ("ip", "l2"):
        got = coded.search_coded_cells(coded.build_coded_cells(docs, centres), asked, centres, 3, 2, metric)
        assert hits(got) == hits(search.knn_exact(docs, asked, 3, metric))
    empty = coded.build_coded_cells(docs.limit(0), centres)
    assert coded.search_coded_cells(empty, asked, centres, 3, 2).count() == 0
    wide = spark.createDataFrame([(7, [1.0, 0.0, 2.0])], "qid long, vector array<float>")
    with pytest.raises(Exception, match="components|mismatch|shape"):
        coded.search_coded_cells(coded.build_coded_cells(docs, centres), wide, centres, 3, 2).collect()


def test_a_search_reads_codes_only(spark, vectors, asked, tmp_path):
    centres = search.train_cells(vectors, 6)
    coded.build_coded_cells(vectors, centres).write.partitionBy("cell").parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i")).withColumn("cell", F.col("cell").cast("long"))
    codes = index.drop("matrix", "ids").join(search._query_blocks(asked.withColumn("cell", F.lit(1).cast("long")), ["cell"]), "cell")
    plan = codes._jdf.queryExecution().executedPlan().toString()
    assert "codes" in plan and "matrix:binary" not in plan
    sizes = index.select(F.sum(F.length("codes")).alias("c"), F.sum(F.length("matrix")).alias("m")).first()
    assert 4 * sizes.c == sizes.m


# --- graph


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_graph_against_exact_search(spark, vectors, asked, metric):
    built, changes = graph.build_graph(vectors, 12, metric=metric)
    assert changes[-1] < 0.05 and changes == sorted(changes, reverse=True)
    built = stored(built)
    rows = built.collect()
    assert len(rows) == 1500 and all(len(r.others) == 12 and len(set(r.others)) == 12 and r.id not in r.others for r in rows)
    x = {r.id: np.array(r.vector) for r in rows}
    scores = np.array([x[k] for k in range(1500)])
    if metric == "cosine":
        scores /= np.linalg.norm(scores, axis=1, keepdims=True)
    far = ((scores[:, None] - scores[None, :300]) ** 2).sum(-1)
    near = [set(np.argsort(far[:, k], kind="stable")[1:11]) for k in range(300)]
    own = {r.id: set(r.others) for r in rows}
    assert np.mean([len(near[k] & own[k]) / 10 for k in range(40, 300)]) > 0.9
    found, rounds = graph.search_graph(built, asked, 10, 32, 64, metric)
    exact = {(r.qid, r.id) for r in search.knn_exact(vectors, asked, 10, metric).collect()}
    got = found.collect()
    assert len({(r.qid, r.id) for r in got} & exact) / len(exact) >= 0.9 and 0 < rounds < 20
    value = {(r.qid, r.id): r.score for r in search.score_pairs(vectors, asked, metric).collect()}
    assert all(r.score == pytest.approx(value[r.qid, r.id], rel=1e-6, abs=1e-6) for r in got)
    with pytest.raises(RuntimeError, match="still to be followed"):
        graph.search_graph(built, asked, 10, 32, 16, metric, most_rounds=0)


def test_edges_of_graphs(spark):
    shape = "id long, vector array<float>"
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, vector array<float>")
    empty, changes = graph.build_graph(spark.createDataFrame([], shape))
    assert empty.count() == 0 and changes == []
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [-1.0, 0.0])]
    built, _ = graph.build_graph(spark.createDataFrame(rows, shape))
    assert {r.id: sorted(r.others) for r in built.collect()} == {1: [2, 4, 5], 2: [1, 4, 5], 4: [1, 2, 5], 5: [1, 2, 4]}
    found, _ = graph.search_graph(built, asked, 3, 4)
    assert [(r.qid, r.id, round(r.score, 3)) for r in found.orderBy("rank").collect()] == [(7, 2, 0.707), (7, 4, 0.707), (7, 1, 0.0)]
    alone, _ = graph.build_graph(spark.createDataFrame(rows[:1], shape))
    assert alone.first().others == [] and graph.search_graph(alone, asked, 1)[0].count() == 1
    with pytest.raises(ValueError):
        graph.build_graph(spark.createDataFrame(rows, shape), metric="ip")


# --- pruned exact search


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_pruned_search_is_exact(vectors, asked, metric):
    index = stored(pruned.build_balls(vectors, search.train_cells(vectors, 30), metric, 40))
    assert hits(pruned.knn_pruned(index, asked, 10, metric)) == hits(search.knn_exact(vectors, asked, 10, metric))
    scores = sorted(r.score for r in search.score_pairs(vectors, asked, metric).collect())
    for at in (len(scores) // 50, -len(scores) // 50):
        least = (scores[at] + scores[at + 1]) / 2
        pairs = {(r.qid, r.id): pytest.approx(r.score, rel=1e-6, abs=1e-9) for r in search.score_pairs(vectors, asked, metric, least).collect()}
        assert {(r.qid, r.id): r.score for r in pruned.range_pruned(index, asked, least, metric).collect()} == pairs
    met, every = pruned.pairs_met(index, asked, 10, metric).count(), index.count() * asked.count()
    assert met < 0.5 * every


def test_edges_of_pruned_search(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, 1.0]), (5, [-1.0, 0.0])]
    docs = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "qid long, vector array<float>")
    centres = search.train_cells(docs, 2)
    for metric in ("ip", "cosine", "l2"):
        index = pruned.build_balls(docs, centres, metric, 1)
        for k in (2, 9):
            got = sorted((r.qid, r.rank, r.id, r.score) for r in pruned.knn_pruned(index, asked, k, metric).where("score is not null").collect())
            assert got == sorted((r.qid, r.rank, r.id, r.score) for r in search.knn_exact(docs, asked, k, metric).where("score is not null").collect())
    assert pruned.knn_pruned(pruned.build_balls(docs.limit(0), centres), asked).count() == 0


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_grouped_search_emits_few_rows(vectors, asked, metric):
    docs = vectors.withColumn("g", F.when(F.col("id") % 7 > 0, F.col("id") % 400))
    want = hits(search.group_best(docs, asked, "g", 5, metric))
    assert hits(pruned.group_best_pruned(docs, asked, "g", 5, metric, sample=500)) == want
    assert hits(pruned.group_best_pruned(docs, asked, "g", 5, metric, sample=1)) == want
    few = pruned.group_rows(docs, asked, "g", 5, metric, sample=500).count()
    assert few < 0.15 * search.knn_exact(docs, asked, 1, metric, group="g").count()


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_scores_of_a_block_take_little_memory(metric):
    """All of a block at once: 32 MB for each matrix of scores, of which there were several."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(search.DOC_BLOCK, 16)), rng.normal(size=(search.QUERY_BLOCK, 16))
    made = {"ids": [list(range(len(x)))], "groups": [[""] * len(x)], "width": [16], "matrix": [x.astype("<f8").tobytes()]}
    made |= {"qids": [list(range(len(q)))], "q_width": [16], "q_matrix": [q.astype("<f8").tobytes()]}
    batch = pa.RecordBatch.from_pydict(made)
    tracemalloc.start()
    best = [dict(zip(b["qid"].to_pylist(), b["id"].to_pylist(), strict=True)) for b in search._score_blocks(metric, 1)([batch])]
    scored = sum(b.num_rows for b in search._all_scores(metric, None)([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scored == len(x) * len(q) and most < 32e6
    found = {k: v for b in best for k, v in b.items()}
    for k in (0, 500, len(q) - 1):
        score = x @ q[k] if metric == "ip" else x @ q[k] / np.linalg.norm(x, axis=1) if metric == "cosine" else -((x - q[k]) ** 2).sum(axis=1)
        assert found[k] == score.argmax()


def block_of(x, q, ids=None, groups=None):
    import pyarrow as pa

    made = {"ids": [list(range(len(x))) if ids is None else ids], "groups": [groups or [""] * len(x)], "width": [x.shape[1]], "matrix": [x.astype("<f8").tobytes()]}
    made |= {"qids": [list(range(len(q)))], "q_width": [q.shape[1]], "q_matrix": [q.astype("<f8").tobytes()]}
    return pa.RecordBatch.from_pydict(made)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_copies_leave_a_block_k_times_at_most(metric):
    """All that tied with the k-th best left it: of 4096 copies and 1024 queries, 4 million rows for a task to sort."""
    rng = np.random.default_rng(8)
    x, q = np.tile(rng.normal(size=16), (search.DOC_BLOCK, 1)), rng.normal(size=(search.QUERY_BLOCK, 16))
    q[5] = 0
    ids = rng.permutation(search.DOC_BLOCK).tolist()
    found = [r for b in search._score_blocks(metric, 10)([block_of(x, q, ids)]) for r in b.to_pylist()]
    assert len(found) == 10 * len(q) and all(r["id"] == n % 10 for n, r in enumerate(found))
    assert {r["qid"] for r in found if r["score"] is None} == ({5} if metric == "cosine" else set())
    found = [b.num_rows for b in search._score_blocks(metric, 2)([block_of(x, q, ids, [str(k % 3) for k in ids])])]
    assert sum(found) == 3 * 2 * len(q)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_copies_in_blocks_of_any_shape_have_equal_scores(metric):
    """A product of matrices rounds by its shape, so that a copy with a greater id could come first."""
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=64).astype(np.float32), rng.normal(size=(search.STRIP, 64)).astype(np.float32)
    blocks = [block_of(np.tile(x, (n, 1)), q) for n in (1, 2, 3, 5, 257, 4096)]
    found = [r for b in search._score_blocks(metric, 3)(blocks) for r in b.to_pylist()]
    assert len({(r["qid"], r["score"]) for r in found}) == len(q)


def test_null_ids_and_values_that_are_no_numbers(spark):
    rows = [(3, [np.inf, 0.0]), (1, [np.nan, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [0.0, 0.0]), (0, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, [0.0, 0.0])], "qid long, vector array<double>")
    for metric, best, least in (("ip", [3, None, 0, 2, 4, 1], [None, 0, 2, 4, 1, 3]), ("l2", [None, 0, 2, 4, 1, 3], [4, None, 0, 2, 1, 3])):
        for k in range(1, 7):
            got = [(r.qid, r.id) for r in search.knn_exact(docs, asked, k, metric).orderBy("qid", "rank").collect()]
            assert got == [(7, i) for i in best[:k]] + [(8, i) for i in least[:k]]


def pairs_of(batches, digits=None):
    from decimal import ROUND_HALF_UP, Context, Decimal

    def rounded(x):
        return x if x is None or not np.isfinite(x) else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(700))) + 0.0

    rows = [r for b in batches for r in b.to_pylist()]
    return [(r["qid"], r["id"], r["score"] if digits is None else rounded(r["score"])) for r in rows]


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_scores_that_round_alike_are_all_there_and_side_by_side(metric, monkeypatch):
    """Also of rows without an id, of values that are no numbers, very large or halfway between two numbers, of blocks of any
    shape, and where there are more pairs than are ordered at once."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(400, 2)), [[0, 0], [np.nan, 1], [np.inf, 0], [1e9, 0], [1e200, 1], [0.0125, 0], [-0.0125, 0]]])
    q = np.concatenate([rng.normal(size=(150, 2)), [[0, 0], [1, 0], [-1, 0], [0, np.inf]]])
    ids = [None, *range(1, len(x))]
    blocks = [block_of(x, q, ids), block_of(x[:1], q), block_of(x[400:], q[150:], ids[400:]), block_of(x[::-1], q[:3], ids[::-1])]
    by = {"key": lambda r: (r[0], r[1] is None, r[1] or 0, repr(r[2]))}
    want = sorted(pairs_of(search._all_scores(metric, None)(blocks), 3), **by)
    for bits, strips in ((24, 256), (18, 256), (24, 1)):
        monkeypatch.setattr(search, "PLACE_BITS", bits)
        monkeypatch.setattr(search, "ORDERED_STRIPS", strips)
        assert sorted(pairs_of(search._alike_scores(metric, 3)(blocks), 3), **by) == want
    x, q = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(search.DOC_BLOCK, 8)), rng.normal(size=(search.STRIP, 8))))
    found = [r[2] for r in pairs_of(search._alike_scores(metric, 3)([block_of(x, q)]))]
    turns = np.count_nonzero(np.diff(found))
    assert len(found) == len(x) * len(q) and turns < 2 * len(set(found)) < 20_000
    found = [r[:2] for r in pairs_of(search._alike_scores(metric, 8)([block_of(x, q)]))]  # hardly two alike: as they are
    assert found == sorted(found)


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_a_written_score_of_every_pair_takes_few_bytes(spark, tmp_path, metric):
    """Nine bytes a pair, eight of them its score: some 67 GB of 615,384 vectors."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(11)
    n, asked = search.DOC_BLOCK, search.QUERY_BLOCK
    x = rng.normal(size=(n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.array([50 * k if k < asked else 50 * k + 1 for k in range(n)])
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array(list(x), pa.list_(pa.float32())), "label": pa.array([0] * n, pa.int32())}), tmp_path / "embeddings.parquet")
    catalog.QUERIES[f"score_{metric}"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    found = pq.read_table(files)
    assert found.num_rows == n * asked and sum(f.stat().st_size for f in files) < 6.5 * n * asked
    score = np.full((asked, n), np.nan)
    score[np.asarray(found["qid"]) // 50, np.asarray(found["id"]) // 50] = np.asarray(found["score"])
    product = x[:asked].astype(float) @ x.T.astype(float)
    length = np.linalg.norm(x.astype(float), axis=1)
    want = product if metric == "ip" else product / length[:asked, None] / length if metric == "cosine" else length[:asked, None] ** 2 + length**2 - 2 * product
    assert np.abs(score - want).max() < 0.51e-6


@pytest.mark.parametrize("name", ["score_cosine", "log2_discount"])
def test_a_task_that_scores_holds_one_python_worker(spark, name):
    """Blocks were made in the tasks that score them, again for each partition of the other side."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" in plan


def test_a_table_of_one_partition_is_not_scored_by_one_task(spark, monkeypatch):
    """All 10,000 pairs of 100 blocks were one task's, whose sort grew with the square of the rows."""
    monkeypatch.setattr(search, "DOC_BLOCK", 10)
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    rows = spark.range(0, 1000, 1, 1).select("id", F.lit("").alias("grp"), F.array(F.col("id").cast("double")).alias("vector"))
    docs, queries = search._blocks(rows, "ids", 10), search._query_blocks(rows.withColumnRenamed("id", "qid"))
    pairs = search._pairs_of_blocks(docs, queries).select(F.spark_partition_id().alias("task"), "ids", "qids")
    counts = [r["count"] for r in pairs.groupBy("task").count().collect()]
    assert sum(counts) == pairs.distinct().select("ids", "qids").distinct().count() == 10_000 and max(counts) <= 100


def test_codes_and_queries_meet_as_blocks(spark, vectors):
    """Also where many rows are equal, and where a place is constant or wide."""
    rows = vectors.select("id", F.transform("vector", lambda x, i: F.when(i == 0, 7.0).when(i == 1, x * 1000).otherwise(x).cast("float")).alias("vector"))
    copies = spark.range(2000, 2300).select("id", F.lit(1).alias("one")).join(rows.where("id = 60").select("vector", F.lit(1).alias("one")), "one").drop("one")
    docs = rows.unionByName(copies).unionByName(spark.createDataFrame([(9000, None)], rows.schema))
    asked = docs.where("id % 60 = 0").select(F.col("id").alias("qid"), "vector")
    found = search.knn_sq8(docs, asked, 10)
    assert hits(found) == hits(search.knn_exact(docs, asked, 10)) and found.count() == 10 * asked.where("vector is not null").count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "q_matrix" in plan and "lambdafunction" not in plan  # no expression is evaluated for each pair


def test_bounds_of_a_block_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(search.DOC_BLOCK, 16)), rng.normal(size=(search.QUERY_BLOCK, 16))
    made = {"cell": [0], "ids": [list(range(len(x)))], "width": [16], "matrix": [x.astype("<f8").tobytes()]}
    block = next(coded._coded([pa.RecordBatch.from_pydict(made)]))
    made = {c: block.column(c) for c in block.schema.names if c not in ("ids", "matrix")}
    batch = pa.RecordBatch.from_pydict(made | {"qids": [list(range(len(q)))], "q_width": [16], "q_matrix": [q.astype("<f8").tobytes()]})
    tracemalloc.start()
    found = [b.to_pydict() for b in coded._bounds("cosine", 3)([batch])]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    places = {k: set() for k in range(len(q))}
    for b in found:
        for k, place in zip(b["qid"], b["place"], strict=True):
            places[k].add(place)
    score = q @ x.T / np.linalg.norm(x, axis=1)
    assert all(set(np.argsort(-score[k])[:3].tolist()) <= places[k] for k in range(len(q))) and most < 64e6


def test_links_below_a_floor_stay_in_their_group():
    """Of a group only links leave that a member could keep; before, all did."""
    import pyarrow as pa

    shape = pa.list_(pa.struct([("other", pa.int64()), ("vector", pa.list_(pa.float32())), ("floor", pa.float64())]))
    x = [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0]]
    members = [{"other": k, "vector": v, "floor": f} for k, v, f in zip((5, 2, 9), x, (0.5, 0.999, -np.inf), strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([members], shape)], ["members"])
    found = [r for b in graph._in_groups(2, "cosine")([batch]) for r in b.to_pylist()]
    assert sorted((r["id"], r["other"]) for r in found) == [(5, 2), (9, 2), (9, 5)]
