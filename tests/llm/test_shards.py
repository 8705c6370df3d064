import pytest
from pyspark.sql import functions as F

from lodestar.llm.shards import ShardStore
from lodestar.llm.shared import shared_folder


def store(spark, target=60_000, fan_in=3):
    df = spark.range(0).select("id", F.col("id").cast("string").alias("path"))
    return ShardStore(spark, shared_folder(spark), df.schema, target, fan_in)


def arrival(spark, low, high, parts=2):
    return spark.range(low, high, 1, parts).select("id", F.sha2(F.col("id").cast("string"), 512).alias("path"))


def test_appends_and_compaction_keep_rows(spark):
    s = store(spark)
    for k in range(6):
        s.append(arrival(spark, 500 * k, 500 * k + 500))
        s.compact()
        assert sorted(r.id for r in s.read().select("id").collect()) == list(range(500 * k + 500))
    shards = s.manifest().collect()
    assert sum(r.rows for r in shards) == 3000
    tiers = [r.tier for r in shards if r.tier > 0]
    assert all(tiers.count(t) < 3 for t in tiers)
    before = s.read(3).count()
    s.vacuum(older_than=0)
    assert s.read().count() == 3000 and before > 0


def test_versions_are_committed_once(spark):
    s = store(spark)
    s.append(arrival(spark, 0, 10))
    shards = s.manifest()
    with pytest.raises(RuntimeError):
        s.commit(shards, 0)
    assert s.version() == 1 and s.read().count() == 10


def test_the_second_of_two_writers_fails(spark):
    """Both read version 1; the second one's commit is refused, and the first one's rows stay."""
    first = store(spark)
    first.append(arrival(spark, 0, 10))
    second = ShardStore(spark, first.folder, first.schema)
    late, shards = second.version(), second._written(arrival(spark, 100, 200))
    first.append(arrival(spark, 10, 20))
    with pytest.raises(RuntimeError):
        second.commit(second.manifest(late).unionByName(shards), late)
    assert first.version() == 2 and sorted(r.id for r in first.read().collect()) == list(range(20))


def test_vacuum_leaves_what_another_writer_is_about_to_commit(spark):
    first = store(spark)
    first.append(arrival(spark, 0, 10))
    second = ShardStore(spark, first.folder, first.schema)
    shards = second._written(arrival(spark, 100, 110))
    first.vacuum()
    second.commit(second.manifest().unionByName(shards), 1)
    assert first.read().count() == 20
    first.versions.fs.create(first.versions._file(3), False).close()  # a writer that died while it committed
    assert first.version() == 2
    first.vacuum(older_than=0)
    assert first.version() == 2 and first.read().count() == 20
    assert first.append(arrival(spark, 20, 21)) == 3


def test_old_versions_stay_readable(spark):
    s = store(spark, fan_in=2)
    s.append(arrival(spark, 0, 10, 3))
    s.compact()
    assert s.version() > 1
    assert s.read(1).count() == s.read().count() == 10


def test_edges(spark):
    s = store(spark)
    assert s.read().count() == 0 and s.version() == 0
    s.append(arrival(spark, 0, 0))
    assert s.version() == 1 and s.compact() == 1 and s.read().count() == 0
    with pytest.raises(ValueError):
        s.append(spark.range(3))
    s.append(spark.createDataFrame([(None, None), (1, "é"), (1, "é"), (2, "x" * 300_000)], "id long, path string"))
    assert sorted((str(r.id), len(r.path or "")) for r in s.read().collect()) == [("1", 1), ("1", 1), ("2", 300_000), ("None", 0)]


def test_a_writer_that_dies_stops_nobody(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "doc_id long, text string")
    store = ShardStore(spark, f"file://{tmp_path}/s", docs.schema)
    store.append(docs.where("doc_id < 2"))
    (tmp_path / "s/versions/v00000002").touch()
    store.append(docs.where("doc_id between 2 and 3"))
    store.versions._write("half", store.versions.path(f"{store.folder}/versions/_draft"))
    store.append(docs.where("doc_id > 3"))
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(6))
    store.vacuum(older_than=0)
    assert store.read().count() == 6 and not list((tmp_path / "s/versions").glob("_*"))
