"""Collections on plain Parquet: registry, upserts and deletes as new snapshots, checks and the ledger of load jobs.

A collection is a folder of immutable parts. Each version is one small file that appears whole and is never overwritten; it
holds the declared schema, the partition key, the width of the vectors and the parts, oldest first. Of two writers that follow
the same version one gets an error and has changed nothing. A batch is added as one new part; where a key is in several parts,
the newest part's row counts. Parts are merged when four or more at the end are together as large as the one before them, so a
row is rewritten about log4(rows / batch) times in all, and a reader meets few parts. A reader takes the keys of the newer
parts, which are few, out of the oldest part where it stands: they are broadcast if their number, which the version knows, is
small, and the oldest part is not shuffled then.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import urlsplit

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.functions.text import state_name, valid_id
from lodestar.functions.vectors import has_dim
from lodestar.sources import files
from lodestar.sources.commits import Commits

MOST_KEYS, MOST_VALUE, MOST_TEXT, MOST_OTHER = 42, 1024, 5 << 20, 50 << 20
#: Bounds of text columns of a collection's schema.
SHORTEST, LONGEST = 1, 65535
#: Parts that are merged at once, at least.
MERGE = 4
#: Footers read at a time.
FOOTERS = 8


#: Keys of newer parts that are broadcast to the oldest part, at most: about 16 MB.
MOST_SENT = 1 << 19


@dataclass(frozen=True)
class State:
    """What a version of a collection says."""

    version: int
    schema: StructType | None
    partition_by: tuple[str, ...] = ()
    vector: str | None = None
    dim: int | None = None
    parts: tuple[dict, ...] = ()

    def text(self, *parts: dict) -> str:
        declared = {"partition_by": self.partition_by, "vector": self.vector, "dim": self.dim}
        return json.dumps(declared | {"schema": self.schema.jsonValue(), "parts": parts})


def _versions(spark: SparkSession, folder: str) -> Commits:
    return Commits(spark, f"{folder}/versions")


def version_of(spark: SparkSession, folder: str) -> int:
    """The newest version of a collection; 0 before the first."""
    return _versions(spark, folder).newest()


def state_of(spark: SparkSession, folder: str, version: int | None = None) -> State:
    """The newest or a given version of a collection; version 0 has no schema and no parts."""
    version = version_of(spark, folder) if version is None else version
    if not version:
        return State(0, None)
    said = json.loads(_versions(spark, folder).text(version))
    return State(version, StructType.fromJson(said["schema"]), tuple(said["partition_by"]), said["vector"], said["dim"], tuple(said["parts"]))


def create_collection(
    spark: SparkSession, folder: str, schema: StructType, partition_by: Sequence[str] = (), vector: str | None = None, dim: int | None = None, exists: str = "error"
) -> int:
    """Declare a collection, empty, as version 1: its schema, the columns its files are partitioned by, and the width of its
    vectors. One that is there already is an error, or, with exists="ignore", stays as it is. Returns the version."""
    if exists not in ("error", "ignore"):
        raise ValueError(f"exists must be error or ignore, not {exists!r}")
    lacking = sorted({*partition_by, *([vector] if vector else [])} - set(schema.names))
    if lacking:
        raise ValueError(f"the schema lacks {lacking}")
    version = version_of(spark, folder)
    if not version:
        try:
            return _versions(spark, folder).add(State(0, schema, tuple(partition_by), vector, dim).text(), 0)
        except RuntimeError:
            version = version_of(spark, folder)
    if exists == "error":
        raise CollectionExists(f"{folder} is a collection already")
    return version


class CollectionExists(ValueError):
    """A collection of that name is there already."""


def _fitting(df: DataFrame, state: State) -> DataFrame:
    """df with the declared columns in their order; columns that df lacks are null, others and other types are an error."""
    have, plain = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in state.schema}
    wrong = sorted(f"{c} is {have[c]}, not {plain.get(c, 'declared')}" for c in have if have[c] != plain.get(c))
    if wrong:
        raise ValueError(f"columns do not fit the collection: {wrong}")
    return df.select([F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in state.schema])


def _written(df: DataFrame, folder: str, state: State) -> dict:
    """A new part with the rows of df: path and rows. Vectors that are not of the declared width are an error, found where the
    part is written, and the part is not used then."""
    path = f"{folder}/parts/{uuid.uuid4().hex}"
    checked = bool(state.vector and state.dim)
    bad = ~F.coalesce(has_dim(F.col(state.vector), state.dim), F.lit(False)) if checked else F.lit(False)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("wrong")).write.partitionBy(*state.partition_by).parquet(path)
    if seen.get["wrong"]:
        raise ValueError(f"{seen.get['wrong']} vectors are not {state.dim} wide")
    return {"path": path, "rows": seen.get["rows"]}


def write_snapshot(df: DataFrame, folder: str, partition_by: Sequence[str] = (), after: int | None = None, vector: str | None = None, dim: int | None = None) -> int:
    """Make df the whole content of a collection; returns the version.

    Without `after` the collection is new, with df's schema; if it is there already, this is an error. after: the version that
    df was computed from; df must fit its schema, and if another writer has followed it, this is an error.
    """
    spark = df.sparkSession
    if after is None:
        create_collection(spark, folder, df.schema, partition_by, vector, dim)
        after = 1
    state = state_of(spark, folder, after)
    return _versions(spark, folder).add(state.text(_written(_fitting(df, state), folder, state)), after)


def append_part(df: DataFrame, folder: str, key: str = "id", accept: Callable[[], bool] = lambda: True) -> int | None:
    """Add rows, one per key, that replace those of equal key; returns their number. df must fit the collection's schema; the
    first rows of a new collection declare it. Writes no more than df, but for the merging of parts. accept is asked when the
    rows are written; if it says no, they are not added, and None is returned."""
    spark = df.sparkSession
    state = state_of(spark, folder)
    if not state.version:
        create_collection(spark, folder, df.schema, exists="ignore")
        state = state_of(spark, folder)
    new = _written(_fitting(df, state), folder, state)
    if not accept():
        return None
    version = _versions(spark, folder).add(state.text(*state.parts, new), state.version)
    _merge_parts(spark, folder, key, version)
    return new["rows"]


def _merge_parts(spark: SparkSession, folder: str, key: str, version: int) -> None:
    """Merge the parts at the end that are due. If another writer is faster, the merge is dropped: the rows are in anyway."""
    state = state_of(spark, folder, version)
    parts = state.parts
    first, rows = len(parts) - 1, parts[-1]["rows"]
    while first > 0 and parts[first - 1]["rows"] <= rows:
        first -= 1
        rows += parts[first]["rows"]
    if len(parts) - first >= MERGE:
        merged = _written(_newest_rows(spark, state, parts[first:], key), folder, state)
        with contextlib.suppress(RuntimeError):
            _versions(spark, folder).add(state.text(*parts[:first], merged), version)


def _newest_rows(spark: SparkSession, state: State, parts: Sequence[dict], key: str | None) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], state.schema)
    oldest, *newer = [spark.read.schema(state.schema).parquet(p["path"]).select(state.schema.names) for p in parts]
    if not newer or key is None:
        return reduce(DataFrame.unionByName, newer, oldest)
    marked = reduce(DataFrame.unionByName, (f.withColumn("_part", F.lit(n)) for n, f in enumerate(newer)))
    keys = marked.groupBy(F.col(key).alias("_key")).agg(F.max("_part").alias("_newest"))
    own = marked.join(keys, marked[key].eqNullSafe(keys["_key"]) & (marked["_part"] == keys["_newest"]), "left_semi").drop("_part")
    known = reduce(DataFrame.unionByName, (f.select(F.col(key).alias("_key")) for f in newer))
    known = F.broadcast(known) if sum(p["rows"] for p in parts[1:]) <= MOST_SENT else known
    return oldest.join(known, oldest[key].eqNullSafe(known["_key"]), "left_anti").unionByName(own)


def read_snapshot(spark: SparkSession, folder: str, key: str | None = "id", version: int | None = None) -> DataFrame:
    """The rows of the newest or a given version; without a key, parts are not reconciled."""
    state = state_of(spark, folder, version)
    if not state.version:
        raise ValueError(f"{folder} has no version")
    return _newest_rows(spark, state, state.parts, key)


def vacuum(spark: SparkSession, folder: str, older_than: float = 86_400) -> None:
    """Remove parts that the newest version does not list and that are older than so many seconds: longer than a writer
    takes from its first file to its commit, and than readers keep an older version."""
    versions = _versions(spark, folder)
    newest = versions.newest()
    used = {p["path"].rsplit("/", 1)[1] for p in state_of(spark, folder, newest).parts}
    root = versions.path(f"{folder}/parts")
    for status in versions.fs.listStatus(root) if versions.fs.exists(root) else ():
        old = time.time() - status.getModificationTime() / 1000 >= older_than
        if old and status.getPath().getName() not in used:
            versions.fs.delete(status.getPath(), True)
    versions.remove_stale(older_than, keep=newest)


# --- registry


def register(registry: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """The registry with new rows; an id that is there already, or twice in rows, is an error."""
    repeated = rows.groupBy(key).count().where("count > 1").select(key)
    if rows.join(registry, key, "left_semi").select(key).unionByName(repeated).limit(1).count():
        raise ValueError("an id is registered already")
    return registry.unionByName(rows, allowMissingColumns=True)


def patch(registry: DataFrame, changes: DataFrame, fixed: tuple[str, ...] = ("pipeline",), key: str = "id") -> DataFrame:
    """Registry rows with the non-empty values of changes; the map column `tags` is merged, fixed columns stay."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c != key and c not in fixed])
    out = registry.join(new, key, "left")
    for c in registry.columns:
        if f"new_{c}" not in new.columns:
            continue
        if c == "tags":
            empty = F.create_map().cast("map<string,string>")
            old, add = F.coalesce(c, empty), F.coalesce(f"new_{c}", empty)
            value = F.map_concat(_without(old, add), add)
        else:
            value = F.coalesce(F.nullif(F.col(f"new_{c}"), F.lit("")), c)
        out = out.withColumn(c, value).drop(f"new_{c}")
    return out.select(registry.columns)


def _without(tags: Column, others: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~F.map_contains_key(others, k))


def drop(registry: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return registry.join(ids, key, "left_anti")


def info(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Registry rows with their number of documents, 0 if none."""
    counts = documents.groupBy("collection_id").agg(F.count("*").alias("n_documents"))
    joined = registry.join(counts, registry.id == counts.collection_id, "left").drop("collection_id")
    return joined.withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def visible(registry: DataFrame, pipelines: DataFrame, key: str = "pipeline") -> DataFrame:
    """Registry rows of the pipelines (a column of that name) that are served."""
    return registry.join(pipelines.select(key).distinct(), key, "left_semi").select(registry.columns)


def requested_once(requested: DataFrame, key: str = "id") -> DataFrame:
    """The requested ids; one that is requested twice is an error."""
    twice = requested.groupBy(key).count().where("count > 1")
    if twice.limit(1).count():
        raise ValueError(f"a collection is requested more than once, such as {twice.first()[key]!r}")
    return requested


def request_counts(requests: DataFrame, by: str, key: str = "id") -> DataFrame:
    """Per request its ids, distinct ids, and whether one is repeated."""
    counts = requests.groupBy(by, key).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(
        F.sum("n").alias("n"), F.count("*").alias("n_distinct"), (F.max("n") > 1).alias("repeated")
    )


def select_collections(requested: DataFrame, registry: DataFrame, strict: bool = True) -> DataFrame:
    """Requested ids with their registry rows; unknown or repeated ids are an error, unknown ones left out if not strict."""
    if strict and requested_once(requested).join(registry, "id", "left_anti").limit(1).count():
        raise ValueError("unknown collection")
    return requested.join(registry, "id")


def describe(stored: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """field, type and number of values of a stored collection's declared fields: all but the id and the vector."""
    fields = [f for f in stored.schema if f.name not in (id_col, vector_col)]
    counts = stored.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"n{k}") for k, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{k}").alias("n")) for k, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


# --- rows


def last_of(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the last by order."""
    ranks = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(ranks)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, new: DataFrame, mode: str = "must", key: str = "id") -> DataFrame:
    """base with new rows: must replaces rows of equal key, skip only appends, ignore keeps the existing ones."""
    if mode == "skip":
        return base.unionByName(new)
    if mode == "ignore":
        return base.unionByName(new.join(base, key, "left_anti"))
    if mode != "must":
        raise ValueError(f"mode must be must, skip or ignore, not {mode!r}")
    return base.join(new, key, "left_anti").unionByName(new)


def upsert_counts(base: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """How many new rows are inserted, and how many meet an existing key."""
    known = new.join(base.select(key).distinct().withColumn("_k", F.lit(1)), key, "left")
    return known.agg(F.count_if(F.col("_k").isNull()).alias("inserted"), F.count_if(F.col("_k").isNotNull()).alias("existing"))


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """base without the rows that pass; rows for which the condition is null stay."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def delete_ids(base: DataFrame, ids: DataFrame) -> DataFrame:
    """base without the rows whose source_id is among ids (column id), or, for ids no source_id has, whose id is."""
    by_source = ids.join(base.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    by_id = ids.join(by_source, "id", "left_anti")
    kept = base.join(by_source.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return kept.join(by_id, "id", "left_anti").select(base.columns)


def get_by_ids(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_semi")


# --- bucketed tables


def bucketed(df: DataFrame, folder: str, key: str, buckets: int) -> DataFrame:
    """df written once as a table in `buckets` buckets of its key, sorted within each, and read from there.

    Joins and lookups by that key (upsert, get_by_ids, joins with sidecars) then shuffle the other side only, to the buckets.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


# --- checks


def validate_load(incoming: StructType, declared: StructType) -> list[str]:
    """Declared columns that an incoming file lacks; extra columns are allowed."""
    return sorted(set(declared.names) - set(incoming.names))


def _lacks(spark: SparkSession, root: str, path: str, declared: StructType) -> list[str]:
    """Declared columns that are neither in a file's footer nor among its partition folders below root."""
    below = path[path.find(root) + len(root) :] if root in path else ""
    folders = {part.split("=")[0] for part in below.split("/")[:-1] if "=" in part}
    footer = spark.read.parquet(files.escaped(path)).schema
    return [c for c in validate_load(footer, declared) if c not in folders]


def missing_by_file(spark: SparkSession, folder: str, declared: StructType) -> dict[str, list[str]]:
    """path -> declared columns that the file lacks, of every Parquet file in folder that lacks any.

    One job reads the footers inside its tasks. Of stores that only Spark opens, each footer is a job of its own, a few at a
    time. A file that cannot be read is an error.
    """
    found = files.listed(spark, folder)
    first = found.first()
    if first is None:
        return {}
    if files.can_open(first.path):
        read = files.footers(found)
        rows = read.select("path", "error", files.missing_columns(read, declared.names).alias("missing")).where("error is not null or size(missing) > 0").collect()
        broken = {r.path: r.error for r in rows if r.error}
        if broken:
            raise ValueError(f"files cannot be read: {broken}")
        return {r.path: r.missing for r in rows}
    paths = [r.path for r in found.select("path").toLocalIterator()]
    root = urlsplit(folder).path.rstrip("/") + "/"
    lacks = inheritable_thread_target(spark)(lambda path: _lacks(spark, root, path, declared))
    with ThreadPoolExecutor(FOOTERS) as pool:
        return {p: names for p, names in zip(paths, pool.map(lacks, paths), strict=True) if names}


def wrong_widths(spark: SparkSession, folder: str, declared: StructType, vector: str, dim: int) -> DataFrame:
    """path, wrong: files with vectors that are null or not dim wide, and how many."""
    rows = spark.read.schema(declared).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"))
    return rows.agg(F.count_if(~has_dim(F.col(vector), dim)).alias("wrong")).where("wrong > 0")


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules a row breaks (or leaves null), as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def document_rules(
    id_: Column, content: Column, metadata: Column, vector: Column, dim: int, mime_type: Column | None = None, texts: dict[str, int] = {}, arrays: dict[str, int] = {}  # noqa: B006
) -> dict[str, Column]:
    """Limits of documents: id form, content present and at most 5 MiB (50 MiB unless its mime_type is plain text),
    metadata keys and lengths, vector width, and of declared columns: the most characters of texts, the most elements of
    arrays. A null value of a declared column passes."""
    plain = F.lit(True) if mime_type is None else F.coalesce(mime_type == "text/plain", F.lit(False))
    size = F.octet_length(content)
    wide = {f"text:{c}": F.col(c).isNull() | (F.char_length(c) <= most) for c, most in texts.items()}
    many = {f"array:{c}": F.col(c).isNull() | (F.size(c) <= most) for c, most in arrays.items()}
    if any(not SHORTEST <= most <= LONGEST for most in texts.values()):
        raise ValueError(f"the length of a text column must be {SHORTEST} to {LONGEST}")
    return {
        "id": valid_id(id_),
        "content": F.length(content) > 0,
        "content_size": F.when(plain, size <= MOST_TEXT).otherwise(size <= MOST_OTHER),
        "metadata_keys": F.size(metadata) <= MOST_KEYS,
        "metadata_values": F.forall(F.map_values(metadata), lambda v: v.isNull() | (F.char_length(v) <= MOST_VALUE)),
        "vector": F.size(vector) == dim,
        **wide,
        **many,
    }


def split_documents(docs: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(documents that break no rule, the others with their `violations`)."""
    marked = docs.withColumn("violations", violations(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def jobs(ledger: DataFrame, collection: Column | None = None, limit: int | None = None, source: str = "collection_name") -> DataFrame:
    """Load jobs with state names, without job 0, newest first: at most `limit` of each source, and of all."""
    rows = ledger.where("task_id <> 0").withColumn("state_name", state_name(F.col("state")))
    rows = rows if collection is None else rows.where(F.col("collection_name") == collection)
    if limit is None:
        return rows.orderBy(F.desc("task_id"))
    newest = Window.partitionBy(source).orderBy(F.desc("task_id"))
    own = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")
    return own.orderBy(F.desc("task_id")).limit(limit)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
