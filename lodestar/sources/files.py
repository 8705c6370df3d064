"""Files of a load: their footers, read inside tasks, one row per file."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.commits import OBJECT_STORES

FOOTERS = "path string, bytes long, rows long, columns array<struct<name: string, type: string, nulls: long>>, error string"
#: Stores that pyarrow opens.
SCHEMES = ("file", "s3", "s3a", "s3n", "gs", "hdfs")
#: Footers that a task reads at a time, and files of a task.
AT_ONCE, PER_TASK = 8, 256


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the files in folder (or a pattern of folders)."""
    return spark.read.format("binaryFile").load(folder).select("path", "length")


def pages(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """path and length of the files below root in the order of their paths, listed as far as they are asked for: object stores
    list by key, page by page; of other stores a folder is listed when it is reached. Empty files, and names that begin with `_`
    or `.`, are passed over, as Spark does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def keyed() -> Iterator:
        listing = store.listFiles(path, True)
        while listing.hasNext():
            yield listing.next()

    def walked(folder) -> Iterator:
        entries = ((s.getPath().getName() + "/" * s.isDirectory(), s) for s in store.listStatus(folder))
        for name, status in sorted(entries, key=lambda e: e[0].encode()):
            if status.isDirectory() and name[0] not in "_.":
                yield from walked(status.getPath())
            elif not status.isDirectory():
                yield status

    for status in keyed() if store.getUri().getScheme() in OBJECT_STORES else walked(path):
        if status.getLen() and status.getPath().getName()[0] not in "_.":
            yield status.getPath().toString(), status.getLen()


def can_open(path: str) -> bool:
    """Whether tasks can open a path themselves."""
    scheme = re.match(r"([a-z0-9]+):", path)
    return scheme is None or scheme[1] in SCHEMES


def _file_system(path: str):
    from pyarrow import fs

    scheme, rest = re.match(r"(?:([a-z0-9]+):/*)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "hdfs":
        return fs.FileSystem.from_uri(path)
    return fs.GcsFileSystem() if scheme == "gs" else fs.S3FileSystem(), rest


def _footer(path: str) -> dict:
    """The footer of a file, or why it cannot be read."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_type

    try:
        store, inner = _file_system(path)
        with store.open_input_file(inner) as file:
            size, found = file.size(), pq.ParquetFile(file)
            meta, fields = found.metadata, found.schema_arrow
            nulls: dict[str, int | None] = {}
            for group in range(meta.num_row_groups):
                for k in range(meta.num_columns):
                    column = meta.row_group(group).column(k)
                    known = column.statistics.null_count if column.is_stats_set and column.statistics.has_null_count else None
                    before = nulls.get(column.path_in_schema, 0)
                    nulls[column.path_in_schema] = None if known is None or before is None else before + known
            columns = [{"name": f.name, "type": from_arrow_type(f.type).simpleString(), "nulls": nulls.get(f.name)} for f in fields]
            return {"path": path, "bytes": size, "rows": meta.num_rows, "columns": columns, "error": None}
    except Exception as error:
        return {"path": path, "bytes": None, "rows": None, "columns": [], "error": f"{type(error).__name__}: {error}"[:500]}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    column = pa.struct([("name", pa.string()), ("type", pa.string()), ("nulls", pa.int64())])
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("columns", pa.list_(column)), ("error", pa.string())])
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for batch in batches:
            yield pa.RecordBatch.from_pylist(list(pool.map(_footer, batch.column(0).to_pylist())), schema)


def footers(files: DataFrame) -> DataFrame:
    """Per row of files (path): bytes, rows, columns (name, Spark type, nulls where the file says), or the error. One job for
    any number of files; a broken file is a row like others."""
    tasks = 1 + files.count() // PER_TASK
    return files.select("path").repartition(tasks, "path").mapInArrow(_read, FOOTERS)


def folder_columns(path: Column) -> Column:
    """The columns that a path's partition folders give."""
    return F.transform(F.filter(F.split(path, "/"), lambda p: p.contains("=")), lambda p: F.substring_index(p, "=", 1))


def missing_columns(found: DataFrame, declared: list[str]) -> Column:
    """Of rows of footers: the declared columns that neither the file nor its folders have, sorted."""
    have = F.concat(F.transform("columns", lambda c: c["name"]), folder_columns(F.col("path")))
    return F.array_sort(F.array_except(F.array(*map(F.lit, declared)), have))


def escaped(path: str) -> str:
    """A path as Spark reads it where it takes patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


# --- files of given paths


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(path: str | None) -> tuple[str | None, str | None]:
        if path is None:
            return None, "missing: no path"
        try:
            store, inner = _file_system(path)
            with store.open_input_file(inner) as file:
                return file.read().decode(), None
        except FileNotFoundError:
            return None, "missing: no such file"
        except Exception as error:
            return None, f"broken: {type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for batch in batches:
            found = list(pool.map(one, batch.column("path").to_pylist()))
            text, fault = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(fault, pa.string())], [*batch.schema.names, "text", "fault"])


def read_texts(rows: DataFrame) -> DataFrame:
    """rows (with a column path) with the text of each file, or its fault. Exactly these paths are opened, inside tasks, without a
    listing; a missing or unreadable file is a row with a fault that begins with `missing` or `broken`."""
    shape = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    tasks = 1 + rows.count() // PER_TASK
    return rows.repartition(tasks).mapInArrow(_texts, f"{shape}, text string, fault string")


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(row: tuple[str, str]) -> None:
        store, inner = _file_system(row[0])
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inner) as file:
            file.write(row[1].encode())

    with ThreadPoolExecutor(AT_ONCE) as pool:
        for batch in batches:
            list(pool.map(one, zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("path")], ["path"])


def write_texts(rows: DataFrame) -> int:
    """Write rows (path, text) as a file each, inside tasks; a task that runs again writes the same. Returns their number."""
    return rows.select("path", "text").mapInArrow(_put, "path string").count()
