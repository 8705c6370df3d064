"""Footers inside tasks, and the outcome of each file of a load."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestar.operators import collections as C
from lodestar.sources import files, records
from lodestar.streaming import ingest as S

SHAPE = "id long, embedding array<float>, label string"


def write(path, ids, width=2, drop=(), label="x"):
    table = pa.table({"id": pa.array(ids, pa.int64()), "embedding": pa.array([[1.0] * width] * len(ids), pa.list_(pa.float32())), "label": [label if i % 2 else None for i in ids]})
    pq.write_table(table.drop_columns(list(drop)), path, row_group_size=2000, compression="none")


def test_footers(spark, tmp_path):
    write(tmp_path / "a[1].parquet", [1, 2, 3])
    write(tmp_path / "b c%20.parquet", [], drop=["label"])
    (tmp_path / "c.parquet").write_bytes(b"PAR1 no footer")
    found = {r.path.rsplit("/", 1)[1]: r for r in files.footers(files.listed(spark, str(tmp_path))).collect()}
    assert {k: (r.rows, r.error is None) for k, r in found.items()} == {"a[1].parquet": (3, True), "b c%20.parquet": (0, True), "c.parquet": (None, False)}
    assert [tuple(c) for c in found["a[1].parquet"].columns] == [("id", "bigint", 0), ("embedding", "array<float>", None), ("label", "string", 1)]
    assert found["a[1].parquet"].bytes == (tmp_path / "a[1].parquet").stat().st_size
    declared = spark.createDataFrame([], SHAPE).schema
    with pytest.raises(ValueError, match="cannot be read.*c.parquet"):
        C.missing_by_file(spark, str(tmp_path), declared)


def test_one_job_for_any_number_of_files(spark, tmp_path):
    for k in range(40):
        write(tmp_path / f"f{k}.parquet", [k], drop=["label"] if k % 10 == 3 else [])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("footers", "footers")
    try:
        lacking = C.missing_by_file(spark, str(tmp_path), spark.createDataFrame([], SHAPE).schema)
        jobs = tracker.getJobIdsForGroup("footers")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(p.rsplit("/", 1)[1] for p in lacking) == ["f13.parquet", "f23.parquet", "f3.parquet", "f33.parquet"]
    assert len(jobs) <= 6  # listing, counting and reading; not one for each file


def test_every_file_has_its_outcome(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        write(folder / f"good{k}[{k}].parquet", range(10 * k, 10 * k + 10))
    write(folder / "none.parquet", [])
    write(folder / "lacking.parquet", [100], drop=["embedding"])
    write(folder / "wide.parquet", [200, 201], width=3)
    write(folder / "torn.parquet", range(1000, 9000))
    data = bytearray((folder / "torn.parquet").read_bytes())
    at = pq.ParquetFile(folder / "torn.parquet").metadata.row_group(2).column(0)
    begin = at.dictionary_page_offset or at.data_page_offset
    data[begin : begin + 60] = b"\xff" * 60
    (folder / "torn.parquet").write_bytes(data)
    (folder / "junk.parquet").write_bytes(b"x" * 1000)
    schema = spark.createDataFrame([], SHAPE).schema
    paths = [f"file://{tmp_path}/{name}" for name in ("c", "log", "checkpoint")]
    for again in (False, True):  # a second delivery of one file replaces its rows
        if again:
            write(folder / "late.parquet", range(5, 15), label="late")
        S.load_files(spark, f"file://{folder}", schema, *paths, per_batch=20, vector="embedding", dim=2).awaitTermination()
        got = {r.path.rsplit("/", 1)[1]: r for r in S.outcomes(spark, paths[1]).collect()}
        wanted = {f"good{k}[{k}].parquet": ("indexed", 10) for k in range(6)} | {"none.parquet": ("indexed", 0)} | ({"late.parquet": ("indexed", 10)} if again else {})
        wanted |= dict.fromkeys(("lacking.parquet", "wide.parquet", "torn.parquet", "junk.parquet"), ("error", 0))
        assert {k: (r.status, r.rows) for k, r in got.items()} == wanted
        rows = {r.id: r.label for r in C.read_snapshot(spark, paths[0]).collect()}
        assert sorted(rows) == list(range(60)) and rows[7] == ("late" if again else "x")
    reasons = {k: r.reason for k, r in got.items() if r.reason}
    assert "missing" in reasons["lacking.parquet"] and "2 vectors are not 2 wide" in reasons["wide.parquet"]
    assert "of 8000 rows" in reasons["torn.parquet"] and reasons["junk.parquet"]
    assert {r.status: (r.files, r.rows) for r in S.outcome_totals(spark, paths[1]).collect()} == {"indexed": (8, 70), "error": (4, 0)}


def test_sidecars_are_opened_by_their_paths(spark, tmp_path):
    folder = tmp_path / "metas/v0"
    folder.mkdir(parents=True)
    for name, text in (("a", '{"span_uuid": "u1", "x": [1]}'), ("b[1]", "{}"), ("c", "[1]"), ("d", '{"span'), ("other", "{}")):
        (folder / f"{name}.json").write_text(text)
    (folder / "e.json").write_bytes(b"\xff\xfe")
    ids = spark.createDataFrame([(x,) for x in ("a", "b[1]", "c", "d", "e", "gone", None)], "id string")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.id: (r.span_uuid, r.meta, (r.fault or "").split(":")[0]) for r in records.scan_sidecars_of(ids, root).collect()}
        assert got == {"a": ("u1", '{"span_uuid": "u1", "x": [1]}', ""), "b[1]": (None, "{}", ""), "c": (None, None, "broken"), "d": (None, None, "broken"), "e": (None, None, "broken"), "gone": (None, None, "missing"), None: (None, None, "missing")}
    assert records.scan_sidecars_of(ids.limit(0), str(tmp_path)).count() == 0


def test_buckets_are_not_shuffled(spark, tmp_path):
    base = C.bucketed(spark.range(500).withColumn("v", F.lit("old")), f"file://{tmp_path}/b", "id", 4)
    new = spark.range(450, 520).withColumn("v", F.lit("new"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got, rows in ((C.upsert(base, new), 520), (C.get_by_ids(base, new), 50), (base.join(new.withColumnRenamed("v", "w"), "id"), 50)):
            assert got.count() == rows
            plan = got._jdf.queryExecution().executedPlan().toString()
            for scan in (p for p in plan.split("Exchange hashpartitioning")[1:]):
                assert "bucketed" not in scan.split("Range")[0] or "FileScan" not in scan.split("Range")[0]
            assert plan.count("Exchange hashpartitioning") <= 2 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_listing_stops_at_its_limit(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for k in range(30):
        (tmp_path / ("sub" if k % 2 else ".") / f"f{k}.{'json' if k % 3 else 'csv'}").write_text("x" * (k + 1))
    (tmp_path / "_hidden.csv").write_text("x")
    (tmp_path / "empty.csv").touch()
    asked = []
    listed = files.pages
    monkeypatch.setattr(files, "pages", lambda *a: (asked.append(f) or f for f in listed(*a)))
    every = {tuple(r) for r in records.scan_files(spark, str(tmp_path), [".csv"]).collect()}
    assert len(every) == 10 and not asked
    some = {tuple(r) for r in records.scan_files(spark, str(tmp_path), [".csv"], 3).collect()}
    assert some == set(sorted(every)[:3]) and len(asked) < 30
    assert {tuple(r) for r in records.scan_files(spark, str(tmp_path), [".csv"], 99).collect()} == every
    assert records.scan_files(spark, str(tmp_path), [".none"], 2).count() == 0
