"""Queries of collection management: registry, upserts, deletes, checks, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import collections as C
from lodestar.plans.base import query
from lodestar.plans.joins import registry


def created(t):
    """A declared collection, partitioned by language; creating it again is a conflict, then it is filled in two parts."""
    folder = t.work()
    docs = t.documents.select("doc_id", "lang", "n_chars")
    C.create_collection(t.spark, folder, docs.schema, ["lang"])
    empty = C.read_snapshot(t.spark, folder, "doc_id").count()
    conflicts = 0
    for again in (lambda: C.create_collection(t.spark, folder, docs.schema), lambda: C.write_snapshot(docs, folder)):
        try:
            again()
        except C.CollectionExists:
            conflicts += 1
    C.append_part(docs.where("doc_id % 3 > 0"), folder, "doc_id")
    C.append_part(docs.where("doc_id % 3 < 2"), folder, "doc_id")
    found = C.read_snapshot(t.spark, folder, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
    return found.withColumns({"n_before": F.lit(empty).cast("long"), "conflicts": F.lit(conflicts).cast("long")})


query("create_collection", created, "SELECT lang, count(*) AS n, 0 AS n_before, 2 AS conflicts FROM documents GROUP BY lang")
query("register", lambda t: C.register(registry(t), t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("1").alias("pipeline"))), "SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS pipeline FROM nation UNION ALL SELECT 's' || s_suppkey, s_name, '1' FROM supplier")


def patched(t):
    tags = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    rows = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.lit("p").alias("pipeline"), tags("a", "1", "b", "2").alias("tags"))
    changes = t.customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("new")).otherwise("").alias("name"), F.lit("q").alias("pipeline"), tags("b", "3", "c", "4").alias("tags"))
    return C.patch(rows, changes).select("id", "name", "pipeline", F.col("tags")["b"].alias("b"), F.size("tags").cast("long").alias("n_tags"))


query("patch_registry", patched, "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE c_name END AS name, 'p' AS pipeline, CASE WHEN c_custkey % 3 = 0 THEN '3' ELSE '2' END AS b, CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE 2 END AS n_tags FROM customer")
query("drop_collection", lambda t: C.drop(registry(t), t.supplier.select(F.col("s_nationkey").cast("string").alias("id"))).select("id", "name"), "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")


def base_rows(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("value"))


def new_rows(t):
    return t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") + 100).cast("int").alias("value"))


NEW = "n AS (SELECT doc_id AS id, quality + 100 AS value FROM labels), b AS (SELECT vec_id AS id, label AS value FROM embeddings)"
query("upsert", lambda t: C.upsert(base_rows(t), new_rows(t)), f"WITH {NEW} SELECT * FROM n UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM n)")
query("upsert_ignore", lambda t: C.upsert(base_rows(t), new_rows(t), "ignore"), f"WITH {NEW} SELECT * FROM b UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM b)")
query("upsert_skip", lambda t: C.upsert(base_rows(t), new_rows(t), "skip"), f"WITH {NEW} SELECT * FROM b UNION ALL SELECT * FROM n")
query("upsert_counts", lambda t: C.upsert_counts(base_rows(t), new_rows(t)), f"WITH {NEW} SELECT count(*) FILTER (id NOT IN (SELECT id FROM b)) AS inserted, count(*) FILTER (id IN (SELECT id FROM b)) AS existing FROM n")


def in_buckets(t):
    return C.bucketed(base_rows(t), t.work(), "id", 8)


query("upsert_bucketed", lambda t: C.upsert(in_buckets(t), new_rows(t)), f"WITH {NEW} SELECT * FROM n UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM n)")
query("get_by_ids_bucketed", lambda t: C.get_by_ids(in_buckets(t), new_rows(t).where("value > 100")), f"WITH {NEW} SELECT * FROM b WHERE id IN (SELECT id FROM n WHERE value > 100)")
query(
    "delete_by_id",
    lambda t: C.delete_ids(t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id") + 1000000).alias("source_id")), t.labels.select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1000000).otherwise(0)).alias("id"))),
    """WITH b AS (SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN vec_id + 1000000 END AS source_id FROM embeddings),
i AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000 ELSE 0 END AS id FROM labels), s AS (SELECT id FROM i WHERE id IN (SELECT source_id FROM b))
SELECT * FROM b WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM s)) AND id NOT IN (SELECT id FROM i WHERE id NOT IN (SELECT id FROM s))""",
)
query("delete_by_filter", lambda t: C.delete_where(t.documents.select("doc_id", "n_chars", F.when(F.col("lang") != "es", F.col("lang")).alias("lang")), (F.col("lang") == "en") & (F.col("n_chars") > 700)), "SELECT doc_id, n_chars, CASE WHEN lang <> 'es' THEN lang END AS lang FROM documents WHERE NOT (lang = 'en' AND n_chars > 700)")


DIM = 64


def deliveries(t):
    """Vector files as they arrive, one folder each: a good one, one without labels, and one with some vectors cut short."""
    folder = t.work()
    rows = t.embeddings.withColumn("n", F.col("vec_id") % 4)
    short = F.when((F.col("n") == 2) & (F.col("vec_id") % 8 == 2), F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding"))
    for n in range(4):
        own = rows.where(F.col("n") == n).select("vec_id", short.alias("embedding"), "label")
        own = own.withColumn("more", F.lit("x")) if n == 3 else own.drop("label") if n == 1 else own
        own.coalesce(1).write.parquet(f"{folder}/delivery-{n}")
    return folder


def load_report(t):
    """Per delivery: the declared columns that its files lack, and its rows with vectors of a wrong width."""
    folder, declared = deliveries(t), t.embeddings.schema
    missing = C.missing_by_file(t.spark, f"{folder}/*", declared)
    lacks = [(path, ",".join(names)) for path, names in missing.items()]
    delivery = F.regexp_extract("path", "/(delivery-[0-9]+)/", 1)
    wrong = C.wrong_widths(t.spark, f"{folder}/*", declared, "embedding", DIM).select(delivery.alias("delivery"), "wrong")
    sizes = t.spark.read.schema("vec_id long").parquet(f"{folder}/*").groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n")).select(delivery.alias("delivery"), "n")
    faults = t.spark.createDataFrame(lacks, "path string, missing string").select(delivery.alias("delivery"), "missing")
    report = sizes.join(faults, "delivery", "left").join(wrong, "delivery", "left")
    return report.select("delivery", "n", F.coalesce("missing", F.lit("")).alias("missing"), F.coalesce("wrong", F.lit(0)).alias("wrong"))


query("validate_load", load_report, "SELECT 'delivery-' || vec_id % 4 AS delivery, count(*) AS n, CASE WHEN vec_id % 4 = 1 THEN 'label' ELSE '' END AS missing, count(*) FILTER (vec_id % 8 = 2) AS wrong FROM embeddings GROUP BY ALL")
query("schema_difference", lambda t: load_report(t).select("delivery", F.explode(F.split("missing", ",")).alias("column"), "n").where("column <> ''"), "SELECT 'delivery-1' AS delivery, 'label' AS column, count(*) AS n FROM embeddings WHERE vec_id % 4 = 1")


def described(t):
    """The declared fields of a stored collection, with how many rows have a value."""
    folder = t.work()
    C.write_snapshot(t.documents.select(F.col("doc_id").alias("id"), F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), "source", "n_chars", F.array(F.col("n_chars").cast("float")).alias("embedding")), folder)
    return C.describe(C.read_snapshot(t.spark, folder))


query("describe_collection", described, "SELECT unnest(['lang', 'source', 'n_chars']) AS field, unnest(['string', 'string', 'bigint']) AS type, unnest([count(*) FILTER (lang <> 'es'), count(source), count(n_chars)]) AS n FROM documents")


def ledger(t, limit=None):
    rows = t.orders.select(F.col("o_orderkey").alias("task_id"), F.expr("cast(case o_orderstatus when 'O' then 0 when 'F' then 6 else 2 end as int)").alias("state"), F.col("o_orderpriority").alias("collection_name"))
    return C.jobs(rows, None, limit).select("task_id", "state_name", "collection_name")


JOBS = "SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'started' END AS state_name, o_orderpriority AS collection_name FROM orders WHERE o_orderkey <> 0"
query("job_ledger", ledger, JOBS)
query("limit_jobs", lambda t: ledger(t, 25), f"SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY collection_name ORDER BY task_id DESC) AS n FROM ({JOBS})) WHERE n <= 25 ORDER BY task_id DESC LIMIT 25")


def checked(t):
    """Documents against all limits; those of one source are files, and texts and languages have bounds of their own."""
    docs = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    docs = docs.withColumn("parts", F.split("text", "\n")).withColumn("mime", F.when(F.col("source") == "src0", "video/mp4").otherwise("text/plain"))
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"))
    rules = C.document_rules(F.col("doc_id").cast("string"), F.col("text"), meta, F.col("embedding"), 64, F.col("mime"), {"text": 2000, "lang": 2}, {"parts": 3})
    good, bad = C.split_documents(docs, rules)
    return good.select("doc_id", F.lit("").alias("violations")).unionByName(bad.select("doc_id", F.array_join("violations", ",").alias("violations")))


query("check_documents", checked, "SELECT doc_id, concat_ws(',', CASE WHEN text = '' THEN 'content' END, CASE WHEN length(text) > 1024 THEN 'metadata_values' END, CASE WHEN vec_id IS NULL THEN 'vector' END, CASE WHEN length(text) > 2000 THEN 'text:text' END, CASE WHEN length(text) - length(replace(text, chr(10), '')) > 2 THEN 'array:parts' END) AS violations FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
