import json
import math
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import vectors as V
from lodestar.operators import collections as C
from lodestar.operators import embedding, filters, ingest, refine, routing, sampling, search, sessions
from lodestar.plans import search as plans
from lodestar.sources import records, sinks
from lodestar.streaming import ingest as stream


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first().v


# --- vectors and search


def vectors(spark, n=300, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_knn_exact_is_brute_force(spark, metric):
    x, docs = vectors(spark)
    queries = docs.where("id < 7").withColumnRenamed("id", "qid")
    found = search.knn_exact(docs, queries, 5, metric).collect()
    score = x[:7] @ x.T
    if metric == "cosine":
        score /= np.linalg.norm(x[:7], axis=1)[:, None] * np.linalg.norm(x, axis=1)
    if metric == "l2":
        score = -((x[:7, None] - x[None]) ** 2).sum(axis=2)
    for q in range(7):
        assert [r.id for r in sorted((r for r in found if r.qid == q), key=lambda r: r.rank)] == np.argsort(-score[q], kind="stable")[:5].tolist()


def test_knn_keeps_ties_by_id(spark):
    docs = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "id long, vector array<double>")
    queries = docs.limit(1).select(F.lit(0).cast("long").alias("qid"), "vector")
    assert sorted(r.id for r in search.knn_exact(docs, queries, 3).collect()) == [0, 1, 2]


def test_full_probe_equals_exact(spark):
    _, docs = vectors(spark)
    queries = docs.where("id % 20 = 0").withColumnRenamed("id", "qid")
    centres = search.train_cells(docs, 6)
    exact = {(r.qid, r.id) for r in search.knn_exact(docs, queries, 5).collect()}
    assert {(r.qid, r.id) for r in search.knn_ivf(docs, queries, centres, 5, len(centres)).collect()} == exact
    some = {(r.qid, r.id) for r in search.knn_ivf(docs, queries, centres, 5, 4).collect()}
    assert len(some & exact) / len(exact) > 0.7


def test_codes_keep_all_near_copies(spark):
    """Hundreds of copies within one step of the codes, the best of them with the highest ids."""
    base = np.array([1.0, -2.0, 3.0, 0.5])
    copies = [(base * (1 + 1e-6 * i)).tolist() for i in range(300)]
    docs = spark.createDataFrame(list(enumerate([[-50.0] * 4, [-40.0, 40.0, -40.0, 40.0], *copies])), "id long, vector array<double>")
    queries = spark.createDataFrame([(0, base.tolist()), (1, [0.0] * 4)], "qid long, vector array<double>")
    got = plans.sq8(SimpleNamespace(vectors=docs, queries=queries)).collect()
    exact = search.knn_exact(docs, queries, 10).collect()
    assert {(r.qid, r.id, r["rank"]) for r in got} == {(r.qid, r.id, r["rank"]) for r in exact}


def test_dimension_mismatch_is_an_error(spark):
    _, docs = vectors(spark, 5)
    queries = spark.createDataFrame([(0, [1.0])], "qid long, vector array<double>")
    with pytest.raises(Exception, match="components"):
        search.knn_exact(docs, queries, 2).collect()


def test_vectors_of_several_widths_are_an_error(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [1.0] * 5), (2, [1.0])], "id long, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "qid long, vector array<double>")
    with pytest.raises(Exception, match="components"):
        search.knn_exact(docs, queries, 2).collect()


def test_rows_without_a_vector_are_left_out(spark):
    docs = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.5, None])], "id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, vector array<double>")
    got = search.knn_exact(docs, queries, 2).collect()
    assert sorted((r.qid, r.id, r["rank"]) for r in got) == [(0, 0, 1), (0, 2, 2)]
    centres = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert [r.id for r in search.knn_ivf(docs.where("id < 2"), queries, centres, 2, 2).collect()] == [0]


@pytest.mark.parametrize(("spread", "probes"), [(0.15, 2), (None, 10)])
def test_recall_of_cells(spark, spread, probes):
    """Recall of the ten nearest of 40 queries: 2 of 16 cells where vectors cluster, 10 of 16 where they do not."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) if spread is None else rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + spread * rng.normal(size=(3000, 16))
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    queries = docs.where("id % 75 = 0").withColumnRenamed("id", "qid")
    exact = {(r.qid, r.id) for r in search.knn_exact(docs, queries, 10, "cosine").collect()}
    index = search.build_ivf(docs, search.train_cells(docs, 16))
    found = {(r.qid, r.id) for r in search.search_ivf(index, queries, search.train_cells(docs, 16), 10, probes, "cosine").collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_pairs_above_a_score(spark):
    x, docs = vectors(spark, 200)
    queries = docs.where("id < 9").withColumnRenamed("id", "qid")
    got = {(r.qid, r.id) for r in search.score_pairs(docs, queries, "ip", least=2.0).collect()}
    assert got == {(q, i) for q in range(9) for i in range(200) if x[q] @ x[i] >= 2.0}
    near = {(r.qid, r.id) for r in search.score_pairs(docs, queries, "l2", least=5.0).collect()}
    assert near == {(q, i) for q in range(9) for i in range(200) if ((x[q] - x[i]) ** 2).sum() <= 5.0}


def test_k_is_checked(spark):
    _, docs = vectors(spark, 5)
    for k in (0, 16_001):
        with pytest.raises(ValueError):
            search.knn_exact(docs, docs.withColumnRenamed("id", "qid"), k)


def test_normalize(spark):
    assert one(spark, V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, V.l2_normalize(F.array(F.lit(float("nan"))))) is None


def test_gaussian_nll(spark):
    got = one(spark, V.gaussian_nll(F.array(F.lit(0.0)), F.array(F.lit(1.0)), F.array(F.lit(2.0)), F.lit(2.0)))
    assert got == pytest.approx(0.5 * math.log(2 * math.pi) + math.log(2) + 0.125)


def test_ranking_nulls_last(spark):
    hits = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (3, 0.1)], "id long, score double")
    assert [r.id for r in search.rank_scores(hits).collect()] == [3, 1, 2]
    assert [r.id for r in search.rank_scores(hits, dedup=False).collect()] == [3, 1, 3, 2]


def test_payload(spark):
    hits = spark.createDataFrame([(1, {"a": "1", "b": "2"})], "id long, metadata map<string,string>")
    assert search.project_payload(hits, ["a"]).first().metadata == {"a": "1"}
    assert search.project_payload(hits, []).first().metadata == {}
    assert search.project_payload(hits, None).first().metadata == {"a": "1", "b": "2"}
    with pytest.raises(ValueError):
        search.project_payload(hits, ["c"])


# --- text


@pytest.mark.parametrize(("name", "safe"), [("a b", "a_b"), ("9x", "a9x"), ("_x", "_x"), ("", None), ("é", "_")])
def test_safe_name(spark, name, safe):
    assert one(spark, X.safe_name(F.lit(name))) == safe


def test_hash_id(spark):
    import hashlib

    assert one(spark, X.hash_id([F.lit(1), F.lit(None).cast("string")])) == hashlib.sha256(b"1_None").hexdigest()
    assert one(spark, X.hash_id([F.lit(7)])) == "7"
    assert len(one(spark, X.hash_id([]))) == 36


def test_paths(spark):
    assert one(spark, X.stem(F.lit("a/b.c.mp4"))) == "b.c"
    assert one(spark, X.stem(F.lit("a/.hidden"))) == ".hidden"
    assert one(spark, X.relative_key(F.lit("s3://b/x/y"), "s3://b")) == "x/y"
    assert one(spark, X.relative_key(F.lit("s3://c/x"), "s3://b")) is None


# --- collections


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    rows = lambda df: sorted((r.id, r.v) for r in df.collect())
    assert rows(C.upsert(base, new)) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(C.upsert(C.upsert(base, new), new)) == rows(C.upsert(base, new))
    assert rows(C.upsert(base, new, "ignore")) == [(1, "a"), (2, "b"), (3, "d")]
    assert len(rows(C.upsert(base, new, "skip"))) == 4
    with pytest.raises(ValueError):
        C.upsert(base, new, "other")
    assert tuple(C.upsert_counts(base, new).first()) == (1, 1)


def test_registry_refuses_known_ids(spark):
    base = spark.createDataFrame([("1",)], "id string")
    with pytest.raises(ValueError):
        C.register(base, base)
    with pytest.raises(ValueError):
        C.register(base, spark.createDataFrame([("2",), ("2",)], "id string"))
    with pytest.raises(ValueError):
        C.select_collections(spark.createDataFrame([("9",)], "id string"), base)
    assert C.select_collections(spark.createDataFrame([("9",)], "id string"), base, strict=False).count() == 0


def test_snapshots(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    C.write_snapshot(spark.range(3), folder)
    C.write_snapshot(C.read_snapshot(spark, folder).where("id > 0"), folder, after=C.version_of(spark, folder))
    assert sorted(r.id for r in C.read_snapshot(spark, folder).collect()) == [1, 2]
    with pytest.raises(ValueError):
        C.read_snapshot(spark, f"file://{tmp_path}/none")


def test_the_second_of_two_writers_fails(spark, tmp_path):
    """Both compute from version 1; the later commit is refused and changes nothing."""
    folder = f"file://{tmp_path}/c"
    C.write_snapshot(spark.range(3), folder)
    version = C.version_of(spark, folder)
    mine = C.read_snapshot(spark, folder).where("id > 0")
    C.append_part(spark.range(5, 6), folder)
    with pytest.raises(RuntimeError, match="already committed"):
        C.write_snapshot(mine, folder, after=version)
    assert sorted(r.id for r in C.read_snapshot(spark, folder).collect()) == [0, 1, 2, 5]


def test_parts_are_merged_and_the_newest_row_counts(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    for k in range(21):
        assert C.append_part(spark.range(k, k + 3).select("id", F.lit(k).alias("v")), folder) == 3
    expected = {i: min(i, 20) for i in range(23)}
    assert {r.id: r.v for r in C.read_snapshot(spark, folder).collect()} == expected
    parts = C.state_of(spark, folder).parts
    assert len(parts) <= 8 and sum(p["rows"] for p in parts) < 63
    C.vacuum(spark, folder, older_than=0)
    assert {r.id: r.v for r in C.read_snapshot(spark, folder).collect()} == expected
    assert len(list((tmp_path / "c" / "parts").iterdir())) == len(parts)


def test_requests_and_jobs(spark):
    with pytest.raises(ValueError, match="more than once"):
        C.requested_once(spark.createDataFrame([("a",), ("b",), ("a",)], "id string"))
    ledger = spark.createDataFrame([(i, 6, f"c{i % 2}") for i in range(11)], "task_id long, state int, collection_name string")
    assert [r.task_id for r in C.jobs(ledger, None, 3).collect()] == [10, 9, 8]
    lopsided = spark.createDataFrame([(i, 6, "a" if i > 2 else "b") for i in range(9)], "task_id long, state int, collection_name string")
    assert [r.task_id for r in C.jobs(lopsided, None, 4).collect()] == [8, 7, 6, 5]
    assert [r.task_id for r in C.jobs(lopsided, F.lit("b"), 4).collect()] == [2, 1]


def test_document_limits(spark):
    text, file = "x" * ((5 << 20) + 1), "x" * ((50 << 20) + 1)
    rows = [("a", "x", "text/plain", ["1"]), ("b", text, "text/plain", ["1"]), ("c", text, "video/mp4", None), ("d", file, "video/mp4", ["1", "2"]), ("e f", "", None, [])]
    docs = spark.createDataFrame(rows, "id string, content string, mime string, tags array<string>").withColumn("name", F.concat("id", F.lit("é")))
    empty = F.create_map().cast("map<string,string>")
    rules = C.document_rules(F.col("id"), F.col("content"), empty, F.array(F.lit(1.0)), 1, F.col("mime"), {"name": 2}, {"tags": 1})
    good, bad = C.split_documents(docs, rules)
    assert sorted(r.id for r in good.select("id").collect()) == ["a", "c"]
    assert {r.id: sorted(r.violations) for r in bad.select("id", "violations").collect()} == {"b": ["content_size"], "d": ["array:tags", "content_size"], "e f": ["content", "id", "text:name"]}
    with pytest.raises(ValueError):
        C.document_rules(F.col("id"), F.col("content"), empty, F.array(F.lit(1.0)), 1, texts={"name": 0})


# --- routing


def test_documents_are_routed(spark):
    rows = [(1, [1.0], None, None), (2, [1.0], "", None), (3, None, "x", None), (4, None, None, b"x"), (5, [1.0], "x", None), (6, None, "", None), (7, [], None, None), (8, [], "x", None)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>, content string, blob binary")
    parts = routing.route_documents(docs, blob="blob", strict=False)
    assert {k: sorted(r.id for r in v.collect()) for k, v in parts.items()} == {"embedded": [1, 2], "to_index": [3, 4], "ambiguous": [5, 6, 7, 8]}
    with pytest.raises(ValueError):
        routing.route_documents(docs, blob="blob")


def test_queries_are_routed(spark):
    queries = spark.createDataFrame([(1, "t", None, None), (2, None, "aGk=", None), (3, None, None, [0.5])], "qid long, text string, episode string, embedding array<double>")
    got = {k: [(r.qid, r.payload) for r in v.collect()] for k, v in routing.route_queries(queries).items()}
    assert got == {"text": [(1, "t")], "episode": [(2, bytearray(b"hi"))], "embedding": [(3, [0.5])]}
    with pytest.raises(ValueError):
        routing.route_queries(spark.createDataFrame([(1, "t", "aGk=")], "qid long, text string, episode string"))


@pytest.mark.parametrize(
    ("codec", "formats", "width", "height", "fault"),
    [
        ("h264", ["mov", "mp4"], 4096, 4096, None), ("h264", ["mp4"], 4097, 10, "too large"), ("h264", ["mp4"], 5000, None, None), ("ffv1", ["matroska"], 1, 1, "codec"),
        ("vp9", ["Matroska", "webm"], 1, 1, "vp9 container"), ("vp9", ["mp4"], 1, 1, None), (" VP8 ", ["webm"], None, None, None), (None, ["mp4"], 1, 1, "codec"), ("av1", None, None, None, None),
    ],
)
def test_media(spark, codec, formats, width, height, fault):
    probes = spark.createDataFrame([(codec, formats, width, height)], "codec string, formats array<string>, width int, height int")
    good, bad = routing.split_media(probes)
    assert [r.fault for r in bad.collect()] == ([fault] if fault else []) and good.count() == (0 if fault else 1)


def test_typed_metadata_and_stamps(spark):
    df = spark.createDataFrame([({"n": "7", "x": "0.5"},), ({"n": None},)], "m map<string,string>")
    assert [(r.n, r.x) for r in ingest.typed_meta(df, "m", {"n": "long", "x": "double"}).collect()] == [(7, 0.5), (None, None)]
    with pytest.raises(Exception, match="CAST_INVALID"):
        ingest.typed_meta(df, "m", {"x": "long"}).collect()
    rows = ingest.stamp_documents(spark.createDataFrame([(1,), (None,), (None,)], "id long"), "id").collect()
    assert rows[0].source_id == "1" and len({r.source_id for r in rows}) == 3 and rows[0].mime_type == "text/plain"
    assert rows[0].indexed_at == rows[2].indexed_at


def test_long_texts_and_missing_labels_are_errors(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None)], "id long, text string")
    with pytest.raises(ValueError, match="longer"):
        embedding.with_random_vectors(df, "text", 4, 5)
    good, long_ = embedding.with_random_vectors(df, "text", 4, 5, strict=False)
    assert sorted(r.id for r in good.collect()) == [1, 3] and [r.id for r in long_.collect()] == [2]
    with pytest.raises(ValueError, match="not stored.*2"):
        refine.require_labelled(df.where("id > 1").select("id"), df.where("id <> 2"))
    assert refine.require_labelled(df.where("id = 1").select("id"), df).count() == 1


def test_places_in_groups_do_not_depend_on_partitions(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).alias("g"), F.xxhash64("id").alias("o"))
    got = {r.id: (r.g, r.place) for r in sampling.numbered(df, "g", [F.col("o")]).collect()}
    for g in ("hot", None):
        own = sorted((r.o, r.id) for r in df.collect() if r.g == g)
        assert [got[i] for _, i in own] == [(g, n + 1) for n in range(len(own))]


def test_delete_ids_prefers_source_ids(spark):
    base = spark.createDataFrame([("a", "x"), ("x", None), ("b", None)], "id string, source_id string")
    ids = spark.createDataFrame([("x",), ("b",)], "id string")
    assert [r.id for r in C.delete_ids(base, ids).collect()] == ["x"]


# --- ingest


def test_bulk_table_shapes(spark):
    df = spark.createDataFrame([(1, "A", [0.1, 0.2]), (2, None, [0.3, 0.4])], "col1 int, col2 string, embedding array<double>")
    dynamic = ingest.build_bulk_table(df, ["col1"], "embedding", {})
    assert dynamic.columns == ["id", "embedding", "$meta"]
    assert json.loads(dynamic.orderBy("id").collect()[1]["$meta"]) == {"col2": None}
    static = ingest.build_bulk_table(df.withColumn("key", F.col("col1")), ["key"], "embedding", {"col1": "int", "col2": "string"})
    assert static.columns == ["id", "embedding", "col1", "col2"]
    with pytest.raises(ValueError):
        ingest.build_bulk_table(df, ["col1"], "embedding", {"col3": "int"})
    with pytest.raises(ValueError):
        ingest.build_bulk_table(df, ["col1"], "embedding", {}, dynamic=False)


def test_file_metadata(spark):
    files = spark.createDataFrame([("a/x.txt",), ("b.txt",)], "key string")
    meta = spark.createDataFrame([("a/x.txt", {"filename": "own"})], "key string, metadata map<string,string>")
    with pytest.raises(ValueError):
        ingest.join_file_metadata(files, meta)
    got = {r.key: r.metadata for r in ingest.join_file_metadata(files, meta, strict=False).collect()}
    assert got == {"a/x.txt": {"filename": "own"}, "b.txt": {"filename": "b.txt"}}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "p": "x"}, {"id": "", "p": "y"}]))
    (tmp_path / "b.json").write_text('{"id": "1", "p": "x"}\n{"id": "2", "p": null}\n')
    for name in ("a.json", "b.json"):
        assert [r.id for r in records.scan_json_records(spark, str(tmp_path / name), ["id", "p"]).collect()] == ["1"]
    (tmp_path / "c.tsv").write_text("id\tp\n1\tx\n2\t\n")
    assert [r.id for r in records.scan_csv_records(spark, str(tmp_path / "c.tsv"), ["id", "p"]).collect()] == ["1"]
    (tmp_path / "u.csv").write_text("name,url\n a , http://x \n\nb\nname,url\n")
    good, bad = records.scan_url_manifest(spark, str(tmp_path / "u.csv"))
    assert [tuple(r) [:2] for r in good.collect()] == [("a", "http://x"), ("name", "url")]
    assert [r.name for r in bad.collect()] == ["b"]
    (tmp_path / "metas" / "v0").mkdir(parents=True)
    (tmp_path / "metas" / "v0" / "k1.json").write_text('{"span_uuid": "k1", "a": 1}')
    assert tuple(records.scan_sidecar_files(spark, str(tmp_path)).select("id", "span_uuid").first()) == ("k1", "k1")
    names = [r.path.rsplit("/", 1)[1] for r in records.scan_files(spark, str(tmp_path), [".json"], 2).collect()]
    assert names == ["a.json", "b.json"]
    (tmp_path / "map.json").write_text('{"f1": {"k": "v"}}')
    assert tuple(records.scan_sidecar_map(spark, str(tmp_path / "map.json")).first()) == ("f1", {"k": "v"})


def test_generated_vectors_do_not_depend_on_partitions(spark):
    a = records.gen_embeddings(spark, 50, 6, 3)
    b = a.repartition(7)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    x = np.array([r.embedding for r in records.gen_embeddings(spark, 2000, 4).collect()])
    assert abs(x.mean()) < 0.03 and np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)


def test_append_quarantines_zero_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, [3.0, 4.0], {"a": None, "b": "1"}), (2, [0.0, 0.0], {})], "id long, embedding array<double>, metadata map<string,string>")
    rejected = sinks.append_collection(docs, str(tmp_path / "c"))
    assert [r.id for r in rejected.collect()] == [2]
    assert spark.read.parquet(str(tmp_path / "c")).first().metadata == {"b": "1"}


# --- sampling


@pytest.mark.parametrize(("n", "expected"), [(1, [0] * 8), (2, [0] * 7 + [1]), (7, [0, 0, 1, 2, 3, 4, 5, 6]), (8, list(range(8))), (17, [0, 2, 4, 6, 9, 11, 13, 16])])
def test_uniform_rows(spark, n, expected):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    assert [r.id for r in sampling.uniform_rows(df, "g", [F.col("id")], 8).orderBy("sample").collect()] == expected


def test_step_rows(spark):
    df = spark.range(10).select((F.col("id") >= 8).alias("g"), "id")
    good, short = sampling.step_rows(df, "g", [F.col("id")], 3)
    assert sorted(r.id for r in good.collect()) == [0, 2, 4]
    assert [r.g for r in short.collect()] == [True]


def test_split_is_stable(spark):
    a = {tuple(r) for r in sampling.split_validation(spark.range(1000), "id", 0.3).collect()}
    assert a == {tuple(r) for r in sampling.split_validation(spark.range(1000).repartition(9), "id", 0.3).collect()}
    assert 200 < sum(p == "validation" for _, p in a) < 400


# --- refinement


def test_probe_is_optimal_and_starts_at_the_anchor(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    labelled = spark.createDataFrame([(v.tolist(), bool(v[0] > 0)) for v in x], "vector array<double>, label boolean")
    ground = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 2.0, 0.0],)], "vector array<double>")
    w, b = refine.linear_probe(ground, labelled)
    y = x[:, 0] > 0
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(x.T @ (p - y) / 40 + 0.1 * (w - np.array([1, 2, 0])), 0, atol=1e-6)
    assert abs((p - y).mean()) < 1e-6
    w, b = refine.linear_probe(ground, labelled.limit(0))
    assert w.tolist() == [1.0, 2.0, 0.0]
    assert refine.linear_probe(ground.limit(0), labelled.limit(0)) is None
    with pytest.raises(ValueError):
        refine.linear_probe(ground.limit(0), labelled)


@pytest.mark.parametrize(("n", "dim"), [(20, 2), (30, 12)])
def test_classifier_separates(spark, n, dim):
    rng = np.random.default_rng(n)
    rows = [(i, (rng.normal(size=dim) + (3 if i < n // 2 else -3)).tolist(), i < n // 2) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label boolean")
    w, b, c = refine.linear_classifier(df, grid=(1e-2, 1.0, 1e2))
    assert np.isfinite(w).all() and c in (1e-2, 1.0, 1e2)
    assert all((np.dot(v, w) + b > 0) == label for _, v, label in rows)


def test_classifier_is_the_best_of_its_grid(spark):
    """Against Newton's method on the same folds: the same choice, the same fit."""
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(60, 3)), np.arange(60) % 3 == 0
    x[y] += [1.0, 0.5, 0.0]
    df = spark.createDataFrame([(i, v.tolist(), bool(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "id long, vector array<double>, label boolean")
    folds = {r.id: r.fold for r in sampling.stratified_folds(df, "label", [F.xxhash64("id"), F.col("id")], 5).collect()}
    fold = np.array([folds[i] for i in range(60)])
    weight = np.where(y, 60 / (2 * y.sum()), 60 / (2 * (~y).sum()))

    def fit(own, penalty):
        x1, w = np.c_[x[own], np.ones(own.sum())], np.zeros(4)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x1 @ w))
            grad = x1.T @ (weight[own] * (p - y[own])) / weight[own].sum() + penalty * np.r_[w[:3], 0]
            hess = (x1 * (weight[own] * p * (1 - p))[:, None]).T @ x1 / weight[own].sum() + penalty * np.diag([1, 1, 1, 0])
            w = w - np.linalg.solve(hess, grad)
        return w

    def f1(w, own):
        said = np.c_[x[own], np.ones(own.sum())] @ w > 0
        return 2 * (said & y[own]).sum() / max(1, said.sum() + y[own].sum())

    grid = (1e-3, 1e-1, 10.0)
    means = [np.mean([f1(fit(fold != k, 1 / (c * 0.8 * 60)), fold == k) for k in range(5)]) for c in grid]
    w, b, c = refine.linear_classifier(df, grid=grid)
    assert c == grid[int(np.argmax(means))]
    assert np.allclose([*w, b], fit(np.ones(60, bool), 1 / (c * 60)), atol=1e-3)
    assert len(refine.GRID) == 100 and refine.GRID[0] == pytest.approx(1e-5) and refine.GRID[-1] == pytest.approx(1e5)


def test_classifier_filter_is_strict(spark):
    df = spark.createDataFrame([("a", [-1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 0.0])], "id string, vector array<double>")
    assert [r.id for r in refine.keep_by_classifier(df, [1.0, 0.0]).collect()] == ["b"]
    assert refine.keep_by_classifier(df, None).count() == 3


def test_quality_scorer_is_linear(spark):
    x, docs = vectors(spark, 200, 4)
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-6)
    score = 10 * (unit @ [0.1, -0.2, 0.3, 0.0] + 0.5)
    rows = docs.join(spark.createDataFrame([(i, float(s)) for i, s in enumerate(score)], "id long, label double"), "id")
    coef, intercept = refine.fit_quality_scorer(rows)
    assert np.allclose([*coef, intercept], [0.1, -0.2, 0.3, 0.0, 0.5], atol=1e-4)


# --- time, embedding


def test_nearest_timestamp_ties(spark):
    rows = spark.createDataFrame([("s", 10.0, 1), ("s", 20.0, 2), ("s", 20.0, 3), ("t", 0.0, 4)], "session string, ts double, id long")
    look = spark.createDataFrame([(1, "s", 15.0), (2, "s", 0.0), (3, "s", 99.0), (4, "t", 5.0), (5, "none", 5.0)], "lookup_id long, session string, at double")
    for width in (0.5, 7.0, 3600.0):
        assert {r.lookup_id: r.id for r in sessions.nearest_timestamp(look, rows, width).collect()} == {1: 1, 2: 1, 3: 2, 4: 4}


def test_segments_include_their_ends(spark):
    rows = spark.createDataFrame([("s", float(k), k) for k in range(30)], "session string, ts double, id long")
    cut = spark.createDataFrame([(1, "s", 3.0, 12.0), (2, "s", 5.0, 4.0)], "segment_id long, session string, low double, high double")
    assert sorted(r.id for r in sessions.segment_join(cut, rows, 4.0).collect()) == list(range(3, 13))


def test_embedder_contract(spark):
    df = spark.createDataFrame([(i, f"text {i}" if i % 5 else None) for i in range(130)], "id long, text string")
    got = {r.id: r.embedding for r in embedding.embed_column(df, "text", embedding.hash_embedder(16), 16).collect()}
    assert got[0] is None and len(got[1]) == 16 and np.linalg.norm(got[1]) == pytest.approx(1)
    again = {r.id: r.embedding for r in embedding.embed_column(df.repartition(5), "text", embedding.hash_embedder(16), 16, batch=7).collect()}
    assert got == again
    with pytest.raises(Exception, match="embedder made"):
        embedding.embed_column(df, "text", embedding.hash_embedder(8), 16).collect()


# --- versions and schemas of collections

DECLARED = "id long, lang string, embedding array<float>"


def test_create_refuses_or_leaves_what_is_there(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/c", spark.createDataFrame([], DECLARED).schema
    assert C.create_collection(spark, folder, schema, ["lang"], "embedding", 2) == 1
    assert C.read_snapshot(spark, folder).schema == schema and C.read_snapshot(spark, folder).count() == 0
    C.append_part(spark.createDataFrame([(1, "en", [1.0, 2.0])], DECLARED), folder)
    for again in (lambda: C.create_collection(spark, folder, schema), lambda: C.write_snapshot(spark.range(1), folder)):
        with pytest.raises(C.CollectionExists):
            again()
    assert C.create_collection(spark, folder, schema, exists="ignore") == 2
    assert C.read_snapshot(spark, folder).count() == 1
    with pytest.raises(ValueError, match="lacks"):
        C.create_collection(spark, f"{folder}2", schema, ["year"])


def test_appends_are_held_against_the_schema(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    C.create_collection(spark, folder, spark.createDataFrame([], DECLARED).schema, ["lang"], "embedding", 2)
    for shape, row, said in (("id long, lang double", (1, 2.0), "lang is double, not string"), ("id long, other string", (1, "x"), "other is string, not declared"), (DECLARED, (1, "en", [1.0]), "1 vectors are not 2 wide"), ("id long, lang string", (1, "en"), "vectors")):
        with pytest.raises(ValueError, match=said):
            C.append_part(spark.createDataFrame([row], shape), folder)
    assert C.version_of(spark, folder) == 1
    for k in range(6):
        C.append_part(spark.createDataFrame([([1.0, float(k)], k, "en"), ([2.0, 0.0], 10 + k, "de")], "embedding array<float>, id long, lang string"), folder)
    with pytest.raises(ValueError, match="do not fit"):
        C.write_snapshot(spark.range(2).withColumnRenamed("id", "n"), folder, after=C.version_of(spark, folder))
    state = C.state_of(spark, folder)
    assert C.read_snapshot(spark, folder).count() == 12 and len(state.parts) < 6
    assert all((Path(p["path"].removeprefix("file://")) / "lang=en").is_dir() for p in state.parts)


def test_a_writer_that_dies_stops_nobody(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    C.append_part(spark.range(3), folder)
    (tmp_path / "c/versions/v00000003").touch()  # as left by a writer that created its version before filling it
    C.append_part(spark.range(3, 5), folder)
    monkeypatch.setattr(C.Commits, "_publish", lambda self, text, target: self._write(text[:5], self.path(f"{self.folder}/_dead")) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        C.append_part(spark.range(5, 6), folder)
    monkeypatch.undo()
    C.append_part(spark.range(6, 7), folder)
    assert sorted(r.id for r in C.read_snapshot(spark, folder).collect()) == [0, 1, 2, 3, 4, 6]
    C.vacuum(spark, folder, older_than=0)
    assert [p.name for p in (tmp_path / "c/versions").iterdir() if not p.name.startswith(".")] == [f"v{C.version_of(spark, folder):08d}"]


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_one_of_many_writers_makes_a_version(spark, tmp_path, scheme, monkeypatch):
    """By hard links, and by Hadoop's rename without overwriting."""
    monkeypatch.setattr(C.Commits, "_scheme", lambda self: scheme)
    versions = C.Commits(spark, f"file://{tmp_path}/v")
    assert versions.add("one", 0) == 1
    with pytest.raises(RuntimeError, match="already committed"):
        versions.add("two", 0)
    assert not versions._publish("two", versions._file(1)) and versions.text(1) == "one"
    assert versions.add("two", 1) == 2 and versions.newest() == 2


def test_a_lost_merge_is_dropped(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/c"
    for k in range(3):
        C.append_part(spark.range(k, k + 1), folder)
    merge = C._merge_parts

    def late(spark, folder, key, version):
        monkeypatch.setattr(C, "_merge_parts", lambda *a: None)
        C.append_part(spark.range(50, 51), folder)
        merge(spark, folder, key, version)

    monkeypatch.setattr(C, "_merge_parts", late)
    assert C.append_part(spark.range(99, 100), folder) == 1
    assert sorted(r.id for r in C.read_snapshot(spark, folder).collect()) == [0, 1, 2, 50, 99]


def test_reading_does_not_shuffle_the_oldest_part(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    C.write_snapshot(spark.range(2000).withColumn("v", F.lit("old")), folder)
    C.append_part(spark.createDataFrame([(5, "new"), (None, "new"), (5000, "new")], "id long, v string"), folder)
    C.append_part(spark.createDataFrame([(None, "newest"), (6, "newest")], "id long, v string"), folder)
    got = C.read_snapshot(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    first = plan.split("Union")[1].split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in first and "LeftAnti" in first and "Exchange hashpartitioning" not in first
    assert {(r.id, r.v) for r in got.where("v <> 'old'").collect()} == {(5, "new"), (None, "newest"), (5000, "new"), (6, "newest")}
    assert got.count() == 2002


# --- files of a load


def test_every_file_of_a_load_is_checked(spark, tmp_path):
    def write(folder, *frames):
        (tmp_path / folder).mkdir()
        for n, (rows, shape) in enumerate(frames):
            spark.createDataFrame(rows, shape).toPandas().to_parquet(tmp_path / folder / f"f{n}[{n}].parquet")
        return str(tmp_path / folder)

    shape = "id long, embedding array<double>, label long"
    full = ([(1, [1.0, 2.0], 0)], shape)
    declared = spark.createDataFrame(*full).schema
    load = lambda folder, **more: stream.load_parquet(spark, folder, declared, f"{folder}-c", f"{folder}-l", f"{folder}-k", **more)
    lacking = write("lacking", full, ([(2, [1.0, 2.0])], "id long, embedding array<double>"))
    with pytest.raises(ValueError, match="missing in 1 files.*label"):
        load(lacking)
    wide = write("wide", full, ([(2, [1.0, 2.0, 3.0], 0)], shape))
    with pytest.raises(ValueError, match="not 2 wide.*1"):
        load(wide, dim=2)
    assert not list(tmp_path.glob("*-c"))
    load(write("good", full, ([(2, [3.0, 4.0], 1, "x")], shape + ", more string")), dim=2).awaitTermination()
    assert C.read_snapshot(spark, str(tmp_path / "good-c")).count() == 2


def test_partition_folders_count_as_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "a"), (2, 3, "b")], "id long, n long, part string")
    df.write.partitionBy("part").parquet(str(tmp_path / "t"))
    assert C.missing_by_file(spark, str(tmp_path / "t"), df.schema) == {}


# --- smaller operators


def test_headers_of_each_manifest(spark, tmp_path):
    for k, text in enumerate(("name,url\na,http://a\nName,URL\n", "name,url\nb,\n,\n", "c,http://c\n")):
        (tmp_path / f"m{k}.csv").write_text(text)
    good, bad = records.scan_url_manifest(spark, str(tmp_path))
    assert sorted((r.name, r.url) for r in good.collect()) == [("Name", "URL"), ("a", "http://a"), ("c", "http://c")]
    assert [(r.name, r.url) for r in bad.collect()] == [("b", "")]


def test_exact_validation_and_shares(spark):
    rows = spark.range(101).selectExpr("id", "id % 3 as x")
    split = sampling.split_validation(rows, "id", 0.25, seed=4)
    assert split.columns == ["id", "x", "part"] and split.where("part = 'validation'").count() == 25
    again = sampling.split_validation(rows.repartition(7), "id", 0.25, seed=4)
    assert {tuple(r) for r in split.collect()} == {tuple(r) for r in again.collect()}
    assert sampling.split_validation(rows, "id", 0.25, seed=5).where("part = 'validation'").join(split.where("part = 'validation'"), "id").count() < 25
    shares = sampling.worker_shares(rows, "id", 4).groupBy("worker").count().collect()
    assert {r.worker: r["count"] for r in shares} == {0: 26, 1: 25, 2: 25, 3: 25}
    assert sampling.worker_shares(rows.limit(0), "id", 4).count() == 0


def test_lists_that_are_allowed(spark):
    rows = spark.createDataFrame([("a",), ("a,b",), ("a,c",), ("every",), ("a,every",), ("",), (None,)], "v string")
    ok = rows.where(filters.allowed_lists(F.col("v"), ["a", "b"], "every"))
    assert [r.v for r in ok.collect()] == ["a", "a,b", "every"]


def test_vectors_as_text(spark):
    import base64
    import struct

    values = [[1.5, -2.0], [], None, [0.1] * 7, [float("inf"), -0.0]]
    rows = spark.createDataFrame([(v,) for v in values], "v array<float>").coalesce(1)
    coded = [r[0] for r in rows.select(V.encode_vectors(F.col("v"))).collect()]
    assert coded == [None if v is None else base64.b64encode(struct.pack(f"<{len(v)}f", *v)).decode() for v in values]
    back = rows.select("v", V.decode_vectors(V.encode_vectors(F.col("v"))).alias("b")).collect()
    assert all(r.v == r.b for r in back)
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([("AAA=",)], "t string").select(V.decode_vectors(F.col("t"))).collect()


def test_several_pipelines_are_not_ranked_together(spark):
    docs = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], "id long, vector array<float>, collection_id string")
    asked = spark.createDataFrame([(7, [1.0])], "qid long, vector array<float>")
    one = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "q")], "id string, pipeline string")
    assert search.search_collections(docs, asked, 1, registry=one).count() == 2
    mixed = one.replace("p", "q", ["pipeline"]).unionByName(spark.createDataFrame([("a", "z")], "id string, pipeline string"))
    with pytest.raises(ValueError, match="several pipelines"):
        search.search_collections(docs, asked, 1, registry=mixed)
    assert search.search_collections(docs, asked, 1, rerank=False, registry=mixed).count() == 2
