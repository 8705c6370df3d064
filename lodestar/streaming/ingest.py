"""Incremental ingest with Structured Streaming: discover files, build documents, upsert, log."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestar.functions.text import basename, guess_mime, path_id
from lodestar.functions.vectors import has_dim
from lodestar.operators.collections import append_part, last_of, missing_by_file, wrong_widths
from lodestar.sources import files

#: Files named in an error.
MOST_NAMED = 20


def discover(spark: SparkSession, folder: str, schema: StructType, per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files that arrive in folder, at most per_batch files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def discover_files(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """A stream of (path, length) of files that arrive in folder."""
    shape = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(shape).option("maxFilesPerTrigger", per_batch).load(folder)
    return found.select("path", "length")


def document_rows(files: DataFrame) -> DataFrame:
    """id (a hash of the path, so that redelivery replaces), path, name and MIME type of files."""
    return files.select(path_id(F.col("path")).alias("id"), "path", basename(F.col("path")).alias("name"), guess_mime(F.col("path")).alias("mime_type"))


def upsert_batch(collection: str, log: str, build: Callable[[DataFrame], DataFrame], key: str = "id"):
    """A foreachBatch function: build documents, add them as a part that replaces rows of equal key, log the batch once.

    What a batch writes is in proportion to the batch. A batch that runs again adds the same rows, which changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        new = last_of(build(batch), key, [F.xxhash64(F.to_json(F.struct("*")))])
        rows = append_part(new, collection, key)
        outcome = batch.sparkSession.range(1).select(F.lit(batch_id).alias("batch"), F.lit(rows).cast("long").alias("files"), F.lit("indexed").alias("status"))
        outcome.coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return run


def ingest(stream: DataFrame, collection: str, log: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Take what has arrived, batch by batch, then stop (bounded run)."""
    writer = stream.writeStream.foreachBatch(upsert_batch(collection, log, build)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _read_files(spark: SparkSession, paths: list[str], declared: StructType, base: str) -> DataFrame:
    """The rows of files, with their path (_file); what cannot be read of a file is passed over, and counted by the caller."""
    rows = spark.read.schema(declared).option("ignoreCorruptFiles", True).option("basePath", base).parquet(*map(files.escaped, paths))
    return rows.select("*", F.col("_metadata.file_path").alias("_file"))


def take_files(folder: str, declared: StructType, collection: str, log: str, build: Callable[[DataFrame], DataFrame], key: str, vector: str | None, dim: int | None):
    """A foreachBatch function over paths of files: the rows of good files become a part, and each file has its outcome.

    A file is in error if its footer cannot be read or lacks declared columns, if fewer rows can be read than the footer says,
    or if its vectors have another width. The rows that are read are counted while the part is written; only if they are not
    those of the footers, they are counted by file, and the part is made anew without the files in error.
    """
    bad_width = ~F.coalesce(has_dim(F.col(vector), dim), F.lit(False)) if vector and dim else F.lit(False)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        read = files.footers(batch.select("path"))
        known = read.select("path", "rows", "error", files.missing_columns(read, declared.names).alias("missing")).collect()  # a batch of files
        faults = {r.path: r.error or f"columns are missing: {r.missing}" for r in known if r.error or r.missing}
        rows = {r.path: r.rows for r in known}

        def add(good: list[str]) -> bool:
            seen = Observation()
            watched = _read_files(spark, good, declared, folder).observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad_width).alias("wrong")).drop("_file")
            new = last_of(build(watched), key, [F.xxhash64(F.to_json(F.struct("*")))])
            whole = lambda: seen.get["rows"] == sum(rows[p] for p in good) and not seen.get["wrong"]
            return append_part(new, collection, key, accept=whole) is not None

        good = [p for p in rows if p not in faults]
        if good and not add(good):
            counted = _read_files(spark, good, declared, folder).groupBy(F.col("_file")).agg(F.count("*").alias("n"), F.count_if(bad_width).alias("wrong"), F.bit_xor(F.xxhash64(*declared.names))).collect()  # reads all columns
            found = {_plain(r["_file"]): (r.n, r.wrong) for r in counted}
            for path in good:
                n, wrong = found.get(_plain(path), (0, 0))
                if n != rows[path]:
                    faults[path] = f"{n} of {rows[path]} rows can be read"
                elif wrong:
                    faults[path] = f"{wrong} vectors are not {dim} wide"
            good = [p for p in good if p not in faults]
            if good and not add(good):
                raise RuntimeError(f"files changed while they were read: {good[:MOST_NAMED]}")
        outcomes = [(batch_id, p, "error" if p in faults else "indexed", faults.get(p), 0 if p in faults else n) for p, n in rows.items()]
        table = spark.createDataFrame(outcomes, "batch long, path string, status string, reason string, rows long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    return run


def _plain(path: str) -> str:
    """A path without the differences between Spark's ways to write it."""
    return re.sub(r"^file:/+", "file:/", unquote(path))


def load_files(
    spark: SparkSession,
    folder: str,
    declared: StructType,
    collection: str,
    log: str,
    checkpoint: str,
    per_batch: int = 64,
    build: Callable[[DataFrame], DataFrame] = lambda df: df,
    key: str = "id",
    vector: str | None = None,
    dim: int | None = None,
) -> StreamingQuery:
    """Stream the Parquet files of a folder (and its partition folders) into a collection, each with its own outcome: a broken
    file is an `error` row of the log with its reason, and the others are indexed. Ends with what has arrived."""
    found = discover_files(spark, folder, per_batch)
    writer = found.writeStream.foreachBatch(take_files(folder, declared, collection, log, build, key, vector, dim)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def outcomes(spark: SparkSession, log: str) -> DataFrame:
    """path, status, reason and rows of each file: of a file that was delivered more than once, the last."""
    rows = spark.read.parquet(log)
    return last_of(rows, "path", [F.col("batch")]).select("path", "status", "reason", "rows")


def outcome_totals(spark: SparkSession, log: str) -> DataFrame:
    """Files and rows per status over all batches of a run."""
    return outcomes(spark, log).groupBy("status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def load_parquet(
    spark: SparkSession,
    folder: str,
    declared: StructType,
    collection: str,
    log: str,
    checkpoint: str,
    per_batch: int = 8,
    vector: str = "embedding",
    dim: int | None = None,
) -> StreamingQuery:
    """Stream vector files into a collection. Before anything is written every file that is there is checked: one that lacks
    a declared column, or, if dim is given, holds a vector that is null or of another width, stops the load."""
    missing = missing_by_file(spark, folder, declared)
    if missing:
        raise ValueError(f"columns are missing in {len(missing)} files: {dict(list(missing.items())[:MOST_NAMED])}")
    if dim is not None:
        wrong = wrong_widths(spark, folder, declared, vector, dim).limit(MOST_NAMED).collect()
        if wrong:
            raise ValueError(f"vectors are not {dim} wide: {[tuple(r) for r in wrong]}")
    return ingest(discover(spark, folder, declared, per_batch), collection, log, checkpoint)


def totals(spark: SparkSession, log: str) -> DataFrame:
    """Files per status over all batches of a run."""
    return spark.read.parquet(log).groupBy("status").agg(F.sum("files").alias("files"))
