"""Queries of joins, windows, sampling and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.text import basename
from lodestar.operators import collections as C
from lodestar.operators import ingest, refine, reports, routing, sampling, sessions
from lodestar.plans.base import query
from lodestar.sources import records

# --- joins of ingest


def sidecars(t):
    """Sidecars of documents: the id inside is wrong for every seventh, and French ones have none."""
    inner = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), F.col("doc_id"))).otherwise(F.col("doc_id").cast("string"))
    return t.documents.where("lang <> 'fr'").select(F.col("doc_id").cast("string").alias("id"), inner.alias("span_uuid"), F.to_json(F.struct("source", "n_chars")).alias("meta"))


def id_vectors(t):
    return t.embeddings.select(F.col("vec_id").cast("string").alias("id"), "embedding")


query("join_sidecar", lambda t: ingest.join_sidecar(id_vectors(t), sidecars(t))[0].select("id", F.size("embedding").cast("long").alias("dim"), F.get_json_object("$meta", "$.source").alias("source")), "SELECT vec_id::VARCHAR AS id, 64 AS dim, source FROM embeddings JOIN documents ON doc_id = vec_id WHERE lang <> 'fr' AND doc_id % 7 <> 0")
query("sidecar_mismatch", lambda t: ingest.join_sidecar(id_vectors(t), sidecars(t))[1], "SELECT vec_id::VARCHAR AS id, CASE WHEN lang <> 'fr' THEN 'id mismatch' ELSE 'no sidecar' END AS fault FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE lang IS NULL OR lang = 'fr' OR doc_id % 7 = 0")
KEY = "concat('a/b/', doc_id, '.txt')"
query(
    "join_file_metadata",
    lambda t: ingest.join_file_metadata(t.documents.select(F.expr(KEY).alias("key"), "doc_id"), t.documents.select(F.expr(KEY).alias("key"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata"))).select("doc_id", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["lang"].alias("lang")),
    "SELECT doc_id, doc_id || '.txt' AS filename, lang FROM documents",
)
def labels_of(t, stored=True):
    """Labelled ids, those that are stored or all, and the stored vectors."""
    labels = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("label"))
    vectors = t.vectors.select("id", "vector", F.col("label").alias("collection"))
    return labels.join(vectors, "id", "left_semi") if stored else labels, vectors


query("join_labels", lambda t: refine.require_labelled(*labels_of(t)).select("id", "label", "collection", F.size("vector").cast("long").alias("dim")), "SELECT doc_id AS id, quality = 1 AS label, label AS collection, 64 AS dim FROM labels JOIN embeddings ON vec_id = doc_id")
query("missing_labels", lambda t: refine.missing_labels(*labels_of(t, False)), "SELECT doc_id AS id, quality = 1 AS label FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
query("existing_ids", lambda t: t.documents.select(F.col("doc_id").alias("id")).join(t.vectors, "id", "left_semi"), "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
query("limit_semi_join", lambda t: ingest.limit_records(t.conversations.withColumnRenamed("conv_id", "video_id"), 40, [F.asc("video_id"), F.asc("turn")]).select("video_id", "turn"), "SELECT conv_id AS video_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations ORDER BY conv_id, turn LIMIT 40)")


def registry(t):
    return t.nation.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("pipeline"))


query("select_collections", lambda t: C.select_collections(t.customer.select(F.col("c_nationkey").cast("string").alias("id")).distinct(), registry(t)), "SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS pipeline FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
query("collection_info", lambda t: C.info(registry(t), t.supplier.select(F.col("s_nationkey").cast("string").alias("collection_id"))), "SELECT n_nationkey::VARCHAR AS id, n_name AS name, n_regionkey::VARCHAR AS pipeline, count(s_suppkey) AS n_documents FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
query("filter_visible_collections", lambda t: C.visible(registry(t), t.region.where("r_name <> 'ASIA'").select(F.col("r_regionkey").cast("string").alias("pipeline"))).select("id", "name"), "SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
FILES = "concat('/data/', source, '/', doc_id, '.mp4')"
query("resolve_paths", lambda t: ingest.resolve_paths(t.embeddings.select(F.col("vec_id").alias("video_id"), F.expr("concat('x/', vec_id, '.mp4')").alias("video_path")), t.documents.select(F.expr(FILES).alias("path"))).select("video_id", "found_path"), "SELECT vec_id AS video_id, '/data/' || source || '/' || doc_id || '.mp4' AS found_path FROM embeddings LEFT JOIN documents ON doc_id = vec_id")


def by_presence(t):
    """Customers' files, of which those of one segment were never written, against the listing of what there is."""
    folder = t.work()
    t.customer.where("c_mktsegment <> 'BUILDING'").write.partitionBy("c_mktsegment").parquet(folder)
    listed = records.scan_files(t.spark, folder, [".parquet"]).select(F.regexp_extract("path", "/(c_mktsegment=[^/]+)/[^/]+$", 1).alias("path"))
    rows = t.customer.select("c_custkey", F.concat(F.lit("c_mktsegment="), "c_mktsegment").alias("video_path"))
    there, absent = routing.split_by_presence(rows, listed)
    return there.select("c_custkey", F.lit(True).alias("valid")).unionByName(absent.select("c_custkey", F.lit(False).alias("valid")))


query("valid_path_split", by_presence, "SELECT c_custkey, c_mktsegment <> 'BUILDING' AS valid FROM customer")

# --- time
EVENT_ROWS = "e AS (SELECT user_id AS session, epoch_us(ts) / 1e6 AS ts, event_id AS id, event_type FROM events)"


def event_rows(t):
    return t.events.select(F.col("user_id").alias("session"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("event_id").alias("id"), "event_type")


query(
    "nearest_timestamp",
    lambda t: sessions.nearest_timestamp(
        event_rows(t).where("event_type = 'click'").select(F.col("id").alias("lookup_id"), "session", (F.col("ts") + 30).alias("at")), event_rows(t).where("event_type <> 'click'").select("session", "ts", "id")
    ).select("lookup_id", "id"),
    f"""WITH {EVENT_ROWS}, p AS (
  SELECT l.id AS lookup_id, r.id, row_number() OVER (PARTITION BY l.id ORDER BY abs(l.ts + 30 - r.ts), r.ts, r.id) AS n
  FROM e l JOIN e r ON l.session = r.session WHERE l.event_type = 'click' AND r.event_type <> 'click')
SELECT lookup_id, id FROM p WHERE n = 1""",
)
query(
    "segment_join",
    lambda t: sessions.segment_join(event_rows(t).where("event_type = 'purchase'").select(F.col("id").alias("segment_id"), "session", (F.col("ts") - 36000).alias("low"), F.col("ts").alias("high")), event_rows(t).select("session", "ts", "id"), 36000.0).select("segment_id", "id"),
    f"WITH {EVENT_ROWS} SELECT s.id AS segment_id, r.id FROM e s JOIN e r ON r.session = s.session AND r.ts BETWEEN s.ts - 36000 AND s.ts WHERE s.event_type = 'purchase'",
)
query(
    "progress_rate",
    lambda t: reports.progress(event_rows(t).select(F.col("session").alias("job"), "ts", F.col("id").alias("n"), F.lit(10000.0).alias("target"))).select("job", "n", F.col("gained").cast("long").alias("gained"), F.round("rate", 6).alias("rate"), F.round("percent", 6).alias("percent")),
    f"WITH {EVENT_ROWS} SELECT session AS job, id AS n, id - lag(id) OVER w AS gained, round((id - lag(id) OVER w) / nullif(ts - lag(ts) OVER w, 0), 6) AS rate, round(id / 100, 6) AS percent FROM e WINDOW w AS (PARTITION BY session ORDER BY ts)",
)
query(
    "queue_position",
    lambda t: reports.queue_positions(t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done")), "o_orderpriority", [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.col("position").cast("long").alias("position")),
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'",
)

# --- sampling
TURN = ["turn"]
query(
    "sample_uniform_rows",
    lambda t: sampling.uniform_rows(t.conversations.select("conv_id", "turn"), "conv_id", TURN, 8).select("conv_id", F.col("sample").cast("long").alias("sample"), "turn"),
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, i AS sample, turn FROM c, range(0, 8) g(i) WHERE r = least(floor(i * ((n - 1) / 7.0::DOUBLE)), n - 1)""",
)
query(
    "sample_step_rows",
    lambda t: sampling.step_rows(t.conversations.select("conv_id", "turn"), "conv_id", TURN, 3)[0],
    """WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, turn FROM c WHERE n >= 3 AND r % (n // 3) = 0 AND r < 3 * (n // 3)""",
)
query("assign_batches", lambda t: sampling.assign_batches(t.documents.select("doc_id", "source"), "source", [F.col("doc_id")], 64), "SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
query("stratified_folds", lambda t: sampling.stratified_folds(t.vectors.select("id", "label"), "label", [F.md5(F.col("id").cast("string"))], 5).select("id", "label", F.col("fold").cast("long").alias("fold")), "SELECT vec_id AS id, label, (row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR)) - 1) % 5 AS fold FROM embeddings")
query("sample_n", lambda t: sampling.sample_n(t.benchmark.select("item_id"), "item_id", 20))
def split_sizes(t):
    """Rows of each part and worker."""
    split = sampling.split_validation(t.vectors.select("id"), "id", 0.2)
    shares = sampling.worker_shares(t.vectors.select("id"), "id", 3).groupBy("worker").agg(F.count("*").alias("n"))
    return split.groupBy("part").agg(F.count("*").alias("n")).unionByName(shares.select(F.concat(F.lit("worker "), "worker").alias("part"), "n"))


query(
    "train_val_sizes",
    split_sizes,
    "WITH c AS (SELECT count(*) AS n FROM embeddings) SELECT 'validation' AS part, n // 5 AS n FROM c UNION ALL SELECT 'training', n - n // 5 FROM c UNION ALL SELECT 'worker ' || range, (n - range + 2) // 3 FROM c, range(3)",
)
query("train_val_split", lambda t: sampling.split_validation(t.vectors.select("id"), "id", 0.2))
query(
    "patch_grid",
    lambda t: sampling.patch_grid(t.pages.select(F.col("page_id").alias("id")), [(1, 1), (3, 3)]).select("source_id", F.col("patch_id").cast("long").alias("patch_id"), *[F.round(c, 6).alias(c) for c in ("bbox_x", "bbox_y", "bbox_w", "bbox_h")]),
    "SELECT page_id AS source_id, i AS patch_id, round(CASE WHEN i = 0 THEN 0 ELSE ((i - 1) % 3) / 3.0::DOUBLE END, 6) AS bbox_x, round(CASE WHEN i = 0 THEN 0 ELSE ((i - 1) // 3) / 3.0::DOUBLE END, 6) AS bbox_y, round(CASE WHEN i = 0 THEN 1 ELSE 1 / 3.0::DOUBLE END, 6) AS bbox_w, round(CASE WHEN i = 0 THEN 1 ELSE 1 / 3.0::DOUBLE END, 6) AS bbox_h FROM pages, range(0, 10) g(i)",
)


def cropped(t):
    """Pages' bytes as gray images 64 pixels wide (the last row filled with blanks), cut in 2 x 2 patches."""
    size = F.octet_length("html")
    height = F.greatest(F.lit(1), F.ceil(size / 64)).cast("int")
    images = t.pages.select(F.col("page_id").cast("string").alias("id"), F.unhex(F.concat(F.hex(F.encode("html", "utf-8")), F.repeat(F.lit("20"), (height * 64 - size).cast("int")))).alias("data"), height.alias("height"))
    boxes = sampling.patch_grid(images, [(2, 2)])
    pixels = boxes.join(images.withColumnRenamed("id", "source_id"), "source_id").select("*", F.lit(64).alias("width"), F.lit(1).alias("channels"))
    return sampling.crop_patches(pixels).select("source_id", F.col("patch_id").cast("long").alias("patch_id"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.md5(F.hex("data")).alias("pixels"))


query(
    "patch_crop",
    cropped,
    """WITH p AS (SELECT page_id::VARCHAR AS source_id, hex(encode(html)) AS d, greatest(1, (strlen(html) + 63) // 64) AS h FROM pages),
q AS (SELECT source_id, h, d || repeat('20', (h * 64 - strlen(d) // 2)::BIGINT) AS d FROM p)
SELECT source_id, i AS patch_id, 32 AS width, h // 2 AS height,
  md5(coalesce(list_aggregate(list_transform(range((h // 2) * (i // 2), (h // 2) * (i // 2 + 1)), lambda r: substr(d, (1 + 128 * r + 64 * (i % 2))::BIGINT, 64)), 'string_agg', ''), '')) AS pixels
FROM q, range(0, 4) g(i)""",
)
query("unique_first", lambda t: ingest.unique_first(t.pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")), "host", [F.col("page_id")]), "SELECT min(page_id) AS page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages GROUP BY 2")
query("sidecar_map_build", lambda t: ingest.sidecar_map(t.conversations.select(F.concat(F.lit("r/"), F.col("role"), F.lit("_"), F.col("turn"), F.lit(".mp4")).alias("video_path"), F.col("conv_id").alias("video_id")), F.col("video_id")), "SELECT role || '_' || turn || '.mp4' AS name, max(conv_id) AS video_id FROM conversations GROUP BY 1")
query("name_of_path", lambda t: t.pages.select("page_id", basename(F.col("url")).alias("name")), "SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
