"""Sources: embedding files, object listings, JSON, CSV and URL manifests, sidecars, generated vectors."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.operators.collections import describe
from lodestar.operators.embedding import gaussian_vector
from lodestar.session import stored
from lodestar.sources import files


def scan_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of a file, from its footer."""
    return spark.read.parquet(path).schema


def field_counts(spark: SparkSession, path: str) -> DataFrame:
    """field, type (from the footer) and number of values of each column of a file."""
    return describe(spark.read.parquet(path), "", "")


def scan_files(spark: SparkSession, root: str, extensions: list[str], limit: int | None = None) -> DataFrame:
    """path and length of the files below root whose names end with an extension (case matters).

    With a limit, the first so many by path; the store is listed no further than needed.
    """
    if limit is not None:
        found = (file for file in files.pages(spark, root) if file[0].endswith(tuple(extensions)))
        return spark.createDataFrame(list(itertools.islice(found, limit)), "path string, length long")
    keep = F.lit(False)
    for e in extensions:
        keep = keep | F.endswith("path", F.lit(e))
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length").where(keep)


def truthy(columns: list[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    return ok


def scan_json_records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Records of a JSON array or of JSON lines, whichever the first character says, that have all fields."""
    head = spark.read.text(path).where("trim(value) <> ''").limit(1).first()
    array = bool(head and head.value.lstrip().startswith("["))
    return spark.read.option("multiLine", array).json(path).where(truthy(fields))


def scan_csv_records(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Records of a CSV file with a header, or of a TSV file by its extension, that have all fields."""
    return spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path).where(truthy(fields))


def scan_url_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name and url of two-column files, rows that lack one). A header `name,url` counts only as the first row of its file."""
    raw = spark.read.option("header", False).schema("name string, url string").csv(path)
    rows = raw.select(
        F.trim(F.coalesce("name", F.lit(""))).alias("name"),
        F.trim(F.coalesce("url", F.lit(""))).alias("url"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = stored(rows)  # numbers of rows rise within a file
    firsts = rows.where("block = 0").groupBy("file").agg(F.min_by(F.struct("n", "name", "url"), "n").alias("f"))
    headers = firsts.where("lower(f.name) = 'name' and lower(f.url) = 'url'").select(F.col("f.n").alias("n"))
    rows = rows.join(headers, "n", "left_anti").where("name <> '' or url <> ''").drop("file", "block", "n")
    good = (F.col("name") != "") & (F.col("url") != "")
    return rows.where(good), rows.where(~good)


def scan_sidecar_map(spark: SparkSession, path: str) -> DataFrame:
    """key and metadata (a map) of a JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "metadata"))


def scan_sidecar_files(spark: SparkSession, root: str) -> DataFrame:
    """id (the file's stem), span_uuid and the whole text of metas/v0/<id>.json files."""
    text = spark.read.text(f"{root}/metas/v0/*.json", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return text.select(name.alias("id"), F.get_json_object("value", "$.span_uuid").alias("span_uuid"), F.col("value").alias("meta"))


def sidecar_path(root: str, id_: Column) -> Column:
    """Where the sidecar of an id lies."""
    return F.concat(F.lit(f"{root.rstrip('/')}/metas/v0/"), id_.cast("string"), F.lit(".json"))


def scan_sidecars_of(ids: DataFrame, root: str) -> DataFrame:
    """id, span_uuid, meta (the whole text), fault: the sidecars of the given ids (a column id), opened by their paths. One that is
    missing, or is no JSON object, is a row with a fault."""
    found = files.read_texts(ids.select("id", sidecar_path(root, F.col("id")).alias("path")))
    whole = F.try_variant_get(F.try_parse_json("text"), "$", "map<string,variant>").isNotNull()
    fault = F.coalesce("fault", F.when(~whole, F.lit("broken: no JSON object")))
    return found.select("id", fault.alias("fault"), "text").select(
        "id", F.when(F.col("fault").isNull(), F.get_json_object("text", "$.span_uuid")).alias("span_uuid"), F.when(F.col("fault").isNull(), F.col("text")).alias("meta"), "fault"
    )


def gen_embeddings(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """n rows id vec_00000000.., unit embedding of normal values, $meta; values depend on the number and seed only."""
    rows = spark.range(n)
    return rows.select(
        F.format_string("vec_%08d", "id").alias("id"),
        gaussian_vector(F.col("id"), dim, seed).cast("array<float>").alias("embedding"),
        F.to_json(F.struct(F.col("id").alias("index"))).alias("$meta"),
    )


def unnest_query_matrix(df: DataFrame, matrix: Column, by: str) -> DataFrame:
    """One query row for each vector of a matrix column: the `by` column, place (from 0) and vector."""
    return df.select(by, F.posexplode(matrix).alias("place", "vector"))
