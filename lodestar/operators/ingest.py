"""Columns and joins of ingest: bulk tables, metadata, sidecars, record preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, StructType

from lodestar.functions.text import basename, fill_nan, guess_mime, hash_id, stem
from lodestar.functions.vectors import l2_normalize

ID_NAMES = ("video_id", "id", "item_id", "doc_id")
PATH_NAMES = ("video_path", "video", "path", "file", "url")
CAPTION_NAMES = ("caption", "text", "sentence", "description")


def pack_meta(df: DataFrame, columns: list[str], fillna: bool = True) -> Column:
    """Columns as one JSON object with sorted keys; null values stay, NaN and null numbers become 0.0 if fillna."""
    fields = []
    for name in sorted(columns):
        c = F.col(name)
        fields.append((fill_nan(c) if fillna and isinstance(df.schema[name].dataType, FractionalType) else c).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def build_bulk_table(
    df: DataFrame, id_cols: list[str], vector_col: str, declared: dict[str, str], dynamic: bool = True, fillna: bool = True, normalize: bool = True
) -> DataFrame:
    """The load table: id, embedding (float), declared columns cast to their types, the rest as JSON in $meta.

    A declared column that is missing is an error, as is an undeclared one unless dynamic.
    """
    missing = sorted(set(declared) - set(df.columns))
    if missing:
        raise ValueError(f"declared columns are missing: {missing}")
    rest = [c for c in df.columns if c not in declared and c not in id_cols and c != vector_col]
    if rest and not dynamic:
        raise ValueError(f"undeclared columns: {rest}")
    vector = l2_normalize(F.col(vector_col)) if normalize else F.col(vector_col)
    out = [hash_id([F.col(c) for c in id_cols]).alias("id"), vector.cast("array<float>").alias("embedding")]
    out += [F.col(c).cast(t).alias(c) for c, t in declared.items()]
    if rest:
        out.append(pack_meta(df, rest, fillna).alias("$meta"))
    return df.select(*out)


def typed_meta(df: DataFrame, meta: str, declared: dict[str, str]) -> DataFrame:
    """df with the declared keys of a metadata map of strings as columns of their types; a value that its type cannot hold
    is an error, a missing one null."""
    return df.select("*", *[F.col(meta)[name].cast(kind).alias(name) for name, kind in declared.items()])


def stamp_documents(df: DataFrame, id_col: str, path_col: str | None = None, mime_type: str = "text/plain") -> DataFrame:
    """df with source_id (the id, or a new UUID), indexed_at (the query's time) and mime_type (by the path, or as given)."""
    kind = guess_mime(F.col(path_col)) if path_col else F.lit(mime_type)
    own = F.coalesce(F.col(id_col).cast("string"), F.expr("uuid()"))
    return df.select("*", own.alias("source_id"), F.current_timestamp().alias("indexed_at"), kind.alias("mime_type"))


def flatten_nested(schema: StructType, separator: str = "_", prefix: str = "", path: str = "") -> list[Column]:
    """All leaves of nested structs as string columns named by their path."""
    out = []
    for field in schema:
        name, where = f"{prefix}{field.name}", f"{path}`{field.name}`"
        if isinstance(field.dataType, StructType):
            out += flatten_nested(field.dataType, separator, f"{name}{separator}", f"{where}.")
        else:
            out.append(F.col(where).cast("string").alias(name))
    return out


def resolve_records(df: DataFrame, id_field: str | None = None, path_field: str | None = None, caption_field: str | None = None) -> DataFrame:
    """(video_id, video_path, caption) from whatever the columns are called; the id falls back to the path's stem.

    Rows that lack one of the three are left out.
    """

    def first(names: tuple[str, ...], given: str | None) -> Column:
        there = [c for c in ([given] if given else names) if c in df.columns]
        return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in there], F.lit(None).cast("string"))

    path = first(PATH_NAMES, path_field)
    out = df.select(
        F.coalesce(first(ID_NAMES, id_field), F.nullif(stem(path), F.lit(""))).alias("video_id"),
        path.alias("video_path"),
        first(CAPTION_NAMES, caption_field).alias("caption"),
    )
    return out.dropna()


def join_sidecar(vectors: DataFrame, sidecars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose sidecar's span_uuid is their id, rejected rows with a reason). sidecars: id, span_uuid, meta."""
    joined = vectors.join(sidecars, "id", "left")
    fault = F.when(F.col("span_uuid").isNull(), "no sidecar").when(F.col("span_uuid") != F.col("id"), "id mismatch")
    marked = joined.withColumn("fault", fault)
    good = marked.where("fault is null").select("id", "embedding", F.col("meta").alias("$meta"))
    return good, marked.where("fault is not null").select("id", "fault")


def join_file_metadata(files: DataFrame, metadata: DataFrame, strict: bool = True) -> DataFrame:
    """files (key, ...) with their metadata map; adds filename unless the map has one; a missing key fails if strict."""
    joined = files.join(metadata, "key", "left")
    if strict and joined.where("metadata is null").limit(1).count():
        raise ValueError("a file has no metadata")
    name = F.create_map(F.lit("filename"), basename(F.col("key")))
    empty = F.create_map().cast("map<string,string>")
    meta = F.coalesce("metadata", empty)
    return joined.withColumn("metadata", F.when(F.map_contains_key(meta, "filename"), meta).otherwise(F.map_concat(meta, name)))


def resolve_paths(records: DataFrame, files: DataFrame) -> DataFrame:
    """records with the first file (by path) of the same base name, null if there is none."""
    found = files.groupBy(basename(F.col("path")).alias("name")).agg(F.min("path").alias("found_path"))
    return records.withColumn("name", basename(F.col("video_path"))).join(found, "name", "left").drop("name")


def limit_records(records: DataFrame, n: int, order: list[Column], key: str = "video_id") -> DataFrame:
    """All records of the ids of the first n records by order."""
    return records.join(records.orderBy(*order).limit(n).select(key).distinct(), key, "left_semi")


def unique_first(records: DataFrame, key: str, order: list[Column]) -> DataFrame:
    ranks = Window.partitionBy(key).orderBy(*order)
    return records.withColumn("_n", F.row_number().over(ranks)).where("_n = 1").drop("_n")


def sidecar_map(records: DataFrame, order: Column) -> DataFrame:
    """name, video_id: for each base name the id of its last record by order."""
    return records.groupBy(basename(F.col("video_path")).alias("name")).agg(F.max_by("video_id", order).alias("video_id"))


def prepare_records(df: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """Resolve columns, keep records whose file exists, take the first n ids, one record per path, with its map name."""
    records = resolve_records(df).join(files.select(F.col("path").alias("video_path")).distinct(), "video_path", "left_semi")
    taken = limit_records(records, n, [F.col("video_id").cast("long"), F.col("video_id")])
    return unique_first(taken, "video_path", [F.col("video_id")]).withColumn("name", basename(F.col("video_path")))
