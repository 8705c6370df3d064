"""Queries of incremental ingest: tables are written as arriving files, streamed into a collection, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators.collections import read_snapshot
from lodestar.plans.base import query
from lodestar.sources import files
from lodestar.streaming import ingest as S

DIM = 64


def arrivals(t, parts=4):
    folder = t.work()
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    rows.repartition(parts, "id").write.parquet(folder)
    return folder, rows.schema


def loaded(t):
    folder, schema = arrivals(t)
    out = t.work()
    S.load_parquet(t.spark, folder, schema, f"{out}/collection", f"{out}/log", f"{out}/checkpoint", 2, dim=DIM).awaitTermination()
    return t.spark, out


def stream_load(t):
    spark, out = loaded(t)
    return read_snapshot(spark, f"{out}/collection").select("id", "label")


def redelivered(t):
    """The same files twice, as two streams: rows are replaced, not repeated."""
    folder, schema = arrivals(t)
    out = t.work()
    for run in ("first", "second"):
        S.load_parquet(t.spark, folder, schema, f"{out}/collection", f"{out}/log-{run}", f"{out}/checkpoint-{run}", 4, dim=DIM).awaitTermination()
    return read_snapshot(t.spark, f"{out}/collection").select("id", "label")


def by_label(t):
    """A file for each label, in a folder of its name."""
    folder = t.work()
    rows = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")
    rows.repartition("label").write.partitionBy("label").parquet(folder)
    return folder, rows.schema


def label_of_path():
    return F.regexp_extract("path", "/label=([0-9]+)/", 1).cast("int").alias("label")


def outcomes_of(t):
    """Files by label, one of them broken, streamed into a collection: the log of the run."""
    folder, schema = by_label(t)
    broken = [r.path for r in files.listed(t.spark, f"{folder}/label=3").collect()]
    for path in broken:
        target = t.spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = target.getFileSystem(t.spark._jsc.hadoopConfiguration()).create(target, True)
        stream.write(bytearray(b"not a table"))
        stream.close()
    out = t.work()
    S.load_files(t.spark, folder, schema, f"{out}/collection", f"{out}/log", f"{out}/checkpoint", 4, vector="embedding", dim=DIM).awaitTermination()
    return out


def bounded(t):
    return S.outcome_totals(t.spark, f"{outcomes_of(t)}/log")


def outcome_rows(t):
    """The outcome of each file, and how many of its rows the collection has."""
    out = outcomes_of(t)
    kept = read_snapshot(t.spark, f"{out}/collection").groupBy("label").agg(F.count("*").alias("kept"))
    log = S.outcomes(t.spark, f"{out}/log").select(label_of_path(), "status", F.col("reason").isNotNull().alias("has_reason"), "rows")
    return log.join(kept, "label", "left").select("label", "status", "has_reason", "rows", F.coalesce("kept", F.lit(0)).alias("kept"))


def discovered(t):
    """Files that a stream finds, two at a time, as documents of hashed ids: their names are the labels' folders."""
    folder, _ = by_label(t)
    out = t.work()
    S.ingest(S.discover_files(t.spark, folder, 2), f"{out}/collection", f"{out}/log", f"{out}/checkpoint", S.document_rows).awaitTermination()
    found = read_snapshot(t.spark, f"{out}/collection")
    return found.select(label_of_path(), (F.length("id") > 0).alias("has_id"), "mime_type")


def ingested(t):
    """Documents stream into a collection with hashed ids; every file's rows are logged."""
    folder, out = t.work(), t.work()
    docs = t.documents.select(F.concat(F.lit("d/"), "doc_id").alias("path"), "lang")
    docs.repartition(3, "path").write.parquet(folder)
    build = lambda df: df.select(F.sha2("path", 256).alias("id"), "path", "lang")
    S.ingest(S.discover(t.spark, folder, docs.schema, 1), f"{out}/collection", f"{out}/log", f"{out}/checkpoint", build).awaitTermination()
    return read_snapshot(t.spark, f"{out}/collection")


VECTORS = "SELECT vec_id AS id, label FROM embeddings"
query("stream_discover", discovered, "SELECT DISTINCT label, true AS has_id, 'application/octet-stream' AS mime_type FROM embeddings")
query("stream_ingest", ingested, "SELECT sha256('d/' || doc_id) AS id, 'd/' || doc_id AS path, lang FROM documents")
query("stream_load_parquet", stream_load, VECTORS)
query("bounded_run", bounded, "SELECT CASE WHEN label = 3 THEN 'error' ELSE 'indexed' END AS status, count(DISTINCT label) AS files, count(*) FILTER (label <> 3) AS rows FROM embeddings GROUP BY 1")
query("ingest_outcomes", outcome_rows, "SELECT label, CASE WHEN label = 3 THEN 'error' ELSE 'indexed' END AS status, label = 3 AS has_reason, count(*) FILTER (label <> 3) AS rows, count(*) FILTER (label <> 3) AS kept FROM embeddings GROUP BY label")
query("redelivery", redelivered, VECTORS)
