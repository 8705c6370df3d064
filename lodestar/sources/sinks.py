"""Sinks: JSON lines, CSV, partitioned collections, logs and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import quote_path, relative_key
from lodestar.functions.vectors import l2_normalize


def export_jsonl(records: DataFrame, path: str) -> None:
    """video_id, video, caption per line."""
    records.select("video_id", F.col("video_path").alias("video"), "caption").write.mode("overwrite").json(path)


def export_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def results_wide(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Metadata keys as columns next to id and score (a score of 0 stays 0)."""
    return hits.select("id", *[F.col("metadata")[k].alias(k) for k in keys], "score")


def json_to_bulk(rows: DataFrame) -> DataFrame:
    """id as text, embedding as floats, every other field in $meta."""
    rest = sorted(c for c in rows.columns if c not in ("id", "embedding"))
    meta = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    return rows.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), meta.alias("$meta"))


def append_collection(docs: DataFrame, path: str) -> DataFrame:
    """Append documents with unit vectors and without null metadata values; returns the rows without a usable vector."""
    unit = docs.withColumn("unit", l2_normalize(F.col("embedding")).cast("array<float>"))
    kept = unit.where("unit is not null").withColumn("metadata", F.map_filter("metadata", lambda k, v: v.isNotNull()))
    kept.drop("embedding").withColumnRenamed("unit", "embedding").write.mode("append").parquet(path)
    return unit.where("unit is null").drop("unit")


def partitioned_write(docs: DataFrame, path: str, key: str) -> None:
    """Write docs by the values of key. Rows are dealt by key, and Spark splits a value of many rows into several tasks."""
    docs.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)


def ingest_log(outcomes: DataFrame, path: str) -> None:
    outcomes.select("file", "status").write.mode("append").option("header", True).csv(path)


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def file_manifest(files: DataFrame, root: str, base_url: str) -> DataFrame:
    """relative_path and percent-encoded url of listed files."""
    rows = files.select(relative_key(F.col("path"), root).alias("relative_path"))
    return rows.withColumn("url", F.concat(F.lit(base_url.rstrip("/") + "/"), quote_path(F.col("relative_path"))))


def sidecar_json(sidecar_map: DataFrame, path: str) -> None:
    """{name: {"video_id": id}} one entry per line."""
    sidecar_map.select(F.to_json(F.create_map("name", F.create_map(F.lit("video_id"), F.col("video_id")))).alias("value")).write.mode("overwrite").text(path)
