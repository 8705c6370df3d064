"""Queries of sources, sinks, scalar functions and ingest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.functions import vectors as V
from lodestar.operators import embedding, filters, ingest, routing
from lodestar.plans.aggregates import PER_QUERY, bundle
from lodestar.plans.base import RESULTS, query
from lodestar.sources import files, records, sinks

# --- sources
query("scan_embeddings", lambda t: records.scan_embeddings(t.spark, f"{t.folder}/embeddings.parquet").select("vec_id", "label", F.size("embedding").cast("long").alias("dim")), "SELECT vec_id, label, len(embedding) AS dim FROM embeddings")
query("scan_files", lambda t: records.scan_files(t.spark, t.folder, [".parquet"]).select(X.basename(F.col("path")).alias("name"), "length"))

query("first_n_files", lambda t: records.scan_files(t.spark, t.folder, [".parquet"], 5).select(X.basename(F.col("path")).alias("name"), "length"))


query(
    "read_schema",
    lambda t: records.field_counts(t.spark, f"{t.folder}/embeddings.parquet"),
    "SELECT unnest(['vec_id', 'embedding', 'label']) AS field, unnest(['bigint', 'array<float>', 'int']) AS type, unnest([count(vec_id), count(embedding), count(label)]) AS n FROM embeddings",
)


def truthy_docs(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("video_id"), F.concat("source", F.lit("/"), "doc_id", F.lit(".mp4")).alias("video_path"), F.when(F.col("lang") != "es", F.col("text")).alias("caption"))


RECORDS = "SELECT doc_id::VARCHAR AS video_id, source || '/' || doc_id || '.mp4' AS video_path, md5(text) AS caption FROM documents WHERE lang <> 'es' AND text <> ''"


def json_records(t):
    folder = t.work()
    sinks.export_jsonl(truthy_docs(t), folder)
    return records.scan_json_records(t.spark, folder, ["video_id", "video", "caption"]).select("video_id", F.col("video").alias("video_path"), F.md5("caption").alias("caption"))


def csv_records(t):
    folder = t.work()
    sinks.export_csv(t.pages.select(F.col("page_id").alias("id"), "url", F.when(F.col("page_id") % 5 > 0, F.md5("html")).alias("caption")), folder)
    return records.scan_csv_records(t.spark, folder, ["id", "url", "caption"]).select(F.col("id").cast("long").alias("id"), "url", "caption")


CSV_SQL = "SELECT page_id AS id, url, md5(html) AS caption FROM pages WHERE page_id % 5 > 0 AND url <> ''"
query("scan_json_records", json_records, RECORDS)
query("export_jsonl", json_records, RECORDS)
query("scan_csv_records", csv_records, CSV_SQL)


def url_manifest(t, good=True):
    folder = t.work()
    rows = t.pages.select(F.concat(F.lit(" p"), F.col("page_id"), F.lit(" ")).alias("name"), F.when(F.col("page_id") % 9 > 0, F.col("url")).alias("url"))
    rows.write.option("header", False).csv(folder)
    for other in range(2):  # files with a header, and one of them with a record that looks like one
        own = t.pages.where(F.col("page_id") % 2 == other).select(F.concat(F.lit("q"), "page_id").alias("name"), "url")
        own = own.unionByName(t.region.where(F.col("r_regionkey") == other).select(F.lit("NAME").alias("name"), F.lit("URL").alias("url"))) if other else own
        own.coalesce(1).write.option("header", True).mode("append").csv(folder)
    return records.scan_url_manifest(t.spark, folder)[0 if good else 1]


query("scan_url_manifest", lambda t: url_manifest(t).select("name", "url"), "SELECT 'p' || page_id AS name, trim(url) AS url FROM pages WHERE page_id % 9 > 0 UNION ALL SELECT 'q' || page_id, trim(url) FROM pages UNION ALL SELECT 'NAME', 'URL'")
query("url_manifest_rejects", lambda t: url_manifest(t, False).select("name"), "SELECT 'p' || page_id AS name FROM pages WHERE page_id % 9 = 0")
query("resolve_record_columns", lambda t: ingest.resolve_records(t.pages.select(F.when(F.col("page_id") % 2 == 0, F.col("page_id")).alias("id"), F.concat(F.lit("a/n"), F.col("page_id"), F.lit(".mp4")).alias("path"), F.md5("html").alias("text"))), "SELECT CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR ELSE 'n' || page_id END AS video_id, 'a/n' || page_id || '.mp4' AS video_path, md5(html) AS caption FROM pages")


def sidecars(t):
    """A sidecar for each supplier, one in ten broken and one in ten missing, opened by id."""
    root = t.work()
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    text = F.when(F.col("id") % 10 == 3, F.lit('{"span_uuid": ')).otherwise(F.to_json(F.struct(F.col("name").alias("span_uuid"), "id")))
    files.write_texts(rows.where("id % 10 <> 7").select(records.sidecar_path(root, F.col("id")).alias("path"), text.alias("text")))
    return records.scan_sidecars_of(rows.select("id"), root).select("id", "span_uuid", F.split("fault", ":")[0].alias("fault"))


query("scan_sidecar_files", sidecars, "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 NOT IN (3, 7) THEN s_name END AS span_uuid, CASE s_suppkey % 10 WHEN 3 THEN 'broken' WHEN 7 THEN 'missing' END AS fault FROM supplier")


def sidecar_map(t):
    """One JSON object for each thousand documents, in files of their own, and read back."""
    folder = t.work()
    entry = F.struct(F.col("doc_id").cast("string"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")))
    objects = t.documents.groupBy(F.expr("doc_id div 1000").alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("part").text(folder)
    found = t.spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    return found.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("key", "metadata")).select("key", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["source"].alias("source"))


query("scan_sidecar_map", sidecar_map, "SELECT doc_id::VARCHAR AS key, lang, source FROM documents")
query(
    "gen_embeddings",
    lambda t: records.gen_embeddings(t.spark, t.documents.count(), 32).select("id", F.get_json_object("$meta", "$.index").cast("long").alias("index"), F.size("embedding").cast("long").alias("dim"), F.round(V.norm(F.col("embedding")), 5).alias("norm")),
    "SELECT 'vec_' || lpad(i::VARCHAR, 8, '0') AS id, i AS index, 32 AS dim, 1.0::DOUBLE AS norm FROM range(0, (SELECT count(*) FROM documents)) r(i)",
)
def random_vectors(t):
    """All documents: with a vector, or rejected as too long."""
    good, long_ = embedding.with_random_vectors(t.documents, "text", 16, 3000, strict=False)
    unit = F.forall("embedding", lambda x: (x >= 0) & (x < 1))
    made = good.select("doc_id", F.size("embedding").cast("long").alias("dim"), unit.alias("unit"), F.lit(False).alias("rejected"))
    return made.unionByName(long_.select("doc_id", F.lit(True).alias("rejected")), allowMissingColumns=True)


query("random_vectors", random_vectors, "SELECT doc_id, CASE WHEN length(text) <= 3000 THEN 16 END AS dim, CASE WHEN length(text) <= 3000 THEN true END AS unit, length(text) > 3000 AS rejected FROM documents")
query("unnest_query_matrix", lambda t: records.unnest_query_matrix(t.embeddings, F.array(F.col("embedding"), F.reverse("embedding")), "vec_id").select("vec_id", F.col("place").cast("long").alias("place"), F.element_at("vector", 1).alias("first")), "SELECT vec_id, 0 AS place, embedding[1] AS first FROM embeddings UNION ALL SELECT vec_id, 1, embedding[64] FROM embeddings")
query("embed_column", lambda t: embedding.embed_column(t.documents.select("doc_id", "text"), "text", embedding.hash_embedder(64), 64).select("doc_id", F.size("embedding").cast("long").alias("dim"), F.expr("round(sqrt(aggregate(embedding, 0D, (s, x) -> s + x * x)), 6)").alias("norm")), "SELECT doc_id, 64 AS dim, 1.0::DOUBLE AS norm FROM documents")

# --- bulk tables and metadata


def joined(t):
    return t.embeddings.join(t.documents.select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars"), "vec_id")


def bulk(t, **options):
    return ingest.build_bulk_table(joined(t).drop("label"), ["vec_id", "source"], "embedding", {"lang": "string"}, **options)


query("build_bulk_table", lambda t: bulk(t).select("id", "lang", F.get_json_object("$meta", "$.n_chars").cast("long").alias("n_chars"), F.size("embedding").cast("long").alias("dim")), "SELECT sha256(vec_id || '_' || source) AS id, lang, n_chars, 64 AS dim FROM embeddings JOIN documents ON doc_id = vec_id")


def exported(t):
    folder = t.work()
    bulk(t, normalize=False).write.parquet(folder)
    return t.spark.read.parquet(folder).select("id", F.element_at("embedding", 1).alias("first"), F.col("$meta").alias("meta"))


query("arrow_batch_export", exported, "SELECT sha256(vec_id || '_' || source) AS id, embedding[1] AS first, '{\"n_chars\":' || n_chars || '}' AS meta FROM embeddings JOIN documents ON doc_id = vec_id")


def json_bulk(t):
    folder = t.work()
    t.embeddings.withColumnRenamed("vec_id", "id").write.json(folder)
    rows = t.spark.read.schema("id long, embedding array<double>, label int").json(folder)
    return sinks.json_to_bulk(rows).select("id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.col("$meta").alias("meta"))


query("json_to_bulk", json_bulk, "SELECT vec_id::VARCHAR AS id, round(embedding[1]::DOUBLE, 5) AS first, '{\"label\":' || label || '}' AS meta FROM embeddings")
query("pack_dynamic_meta", lambda t: t.events.withColumn("gap", F.when(F.col("event_id") % 3 > 0, F.lit(1.5))).transform(lambda d: d.select("event_id", ingest.pack_meta(d, ["user_id", "gap", "event_type"]).alias("m"))).select("event_id", F.get_json_object("m", "$.gap").cast("double").alias("gap"), F.get_json_object("m", "$.event_type").alias("event_type")), "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 1.5 ELSE 0.0 END AS gap, event_type FROM events")
def typed(t):
    """Metadata maps of strings, with the declared keys as columns of their types."""
    meta = {"n_chars": F.col("n_chars").cast("string"), "share": (F.col("n_chars") / 7).cast("string"), "english": (F.col("lang") == "en").cast("string"), "lang": F.col("lang")}
    rows = t.documents.select("doc_id", F.create_map(*[x for name, value in meta.items() for x in (F.lit(name), value)]).alias("meta"))
    return ingest.typed_meta(rows, "meta", {"n_chars": "long", "share": "double", "english": "boolean", "lang": "string", "none": "long"}).drop("meta")


query("typed_meta", typed, "SELECT doc_id, n_chars, n_chars / 7.0::DOUBLE AS share, lang = 'en' AS english, lang, NULL::BIGINT AS none FROM documents")
query("flatten_nested", lambda t: t.documents.select("doc_id", F.struct(F.col("lang").alias("code"), F.struct(F.col("source").alias("name"), F.col("n_chars").alias("size")).alias("origin")).alias("meta")).transform(lambda d: d.select(*ingest.flatten_nested(d.schema))), "SELECT doc_id::VARCHAR AS doc_id, lang AS meta_code, source AS meta_origin_name, n_chars::VARCHAR AS meta_origin_size FROM documents")
PREP = "SELECT doc_id::VARCHAR AS video_id, 'v/' || source || '/' || doc_id || '.mp4' AS video_path, md5(text) AS caption, doc_id || '.mp4' AS name FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 100"
query(
    "prepare_records",
    lambda t: ingest.prepare_records(t.documents.select("doc_id", F.expr("concat('v/', source, '/', doc_id, '.mp4')").alias("path"), F.md5("text").alias("caption")), t.labels.join(t.documents, "doc_id").select(F.expr("concat('v/', source, '/', doc_id, '.mp4')").alias("path")), 100),
    PREP,
)
query("asset_url", lambda t: t.documents.select("doc_id", X.fill_template(F.lit("https://h/{{source}}/{{lang}}/{{none}}"), F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang")), ["source", "lang", "none"]).alias("url")), "SELECT doc_id, 'https://h/' || source || '/' || lang || '/{{none}}' AS url FROM documents")

# --- sinks
def appended(t):
    folder = t.work()
    docs = t.embeddings.select(F.col("vec_id").alias("id"), "embedding", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("none"), F.lit(None).cast("string")).alias("metadata"))
    sinks.append_collection(docs, folder)
    return t.spark.read.parquet(folder).select("id", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"), F.size("metadata").cast("long").alias("n_keys"))


query("append_collection", appended, "SELECT vec_id AS id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first, 1 AS n_keys FROM embeddings")


def csv_export(t):
    folder = t.work()
    sinks.export_csv(sinks.results_wide(t.results, ["lang", "source"]).select("id", "lang", "source", F.round("score", 6).alias("score")), folder)
    return t.spark.read.option("header", True).csv(folder).select(F.col("id").cast("long").alias("id"), "lang", "source", F.col("score").cast("double").alias("score"))


query("export_csv", csv_export, f"WITH {RESULTS} SELECT id, lang, source, round(score, 6) AS score FROM r")


def logged(t):
    folder = t.work()
    sinks.ingest_log(t.orders.select(F.col("o_orderkey").cast("string").alias("file"), F.col("o_orderstatus").alias("status")), folder)
    return t.spark.read.option("header", True).csv(folder).select("file", "status")


query("ingest_log", logged, "SELECT o_orderkey::VARCHAR AS file, o_orderstatus AS status FROM orders")
query("file_manifest", lambda t: sinks.file_manifest(t.documents.select(F.expr("concat('/root dir/', source, '/my file ', doc_id, '.mp4')").alias("path")), "/root dir", "https://h/"), "SELECT source || '/my file ' || doc_id || '.mp4' AS relative_path, 'https://h/' || source || '/my%20file%20' || doc_id || '.mp4' AS url FROM documents")


def partitioned(t):
    folder = t.work()
    sinks.partitioned_write(t.documents, folder, "lang")
    return t.spark.read.parquet(folder).where("lang = 'de'").select("doc_id", "source", "lang")


query("partitioned_write", partitioned, "SELECT doc_id, source, lang FROM documents WHERE lang = 'de'")


def metrics_file(t):
    folder = t.work()
    sinks.metrics_json(bundle(t), folder)
    return t.spark.read.json(folder).select("n_queries", "total_hits", F.round("mrr", 6).alias("mrr"))


query("metrics_json", metrics_file, f"WITH {PER_QUERY} SELECT count(*) AS n_queries, sum(n_hits)::BIGINT AS total_hits, round(avg(mrr), 6) AS mrr FROM pq")

# --- scalar functions
query("hash_id", lambda t: t.documents.select("doc_id", X.hash_id([F.col("doc_id"), F.when(F.col("lang") != "es", F.col("lang"))]).alias("id")), "SELECT doc_id, sha256(doc_id || '_' || CASE WHEN lang <> 'es' THEN lang ELSE 'None' END) AS id FROM documents")
query("path_id", lambda t: t.pages.select("page_id", X.path_id(F.col("url")).alias("id")), "SELECT page_id, sha256(url) AS id FROM pages")
query("safe_name", lambda t: t.pages.select("page_id", X.safe_name(F.concat(F.col("page_id"), F.col("url"))).alias("name")), "SELECT page_id, substr('a' || regexp_replace(page_id || url, '[^0-9A-Za-z_]', '_', 'g'), 1, 255) AS name FROM pages")
query("check_ids", lambda t: t.pages.select("page_id", X.valid_id(F.col("page_id").cast("string")).alias("plain"), X.valid_id(F.col("url")).alias("url"), X.is_uuid(F.md5("url")).alias("uuid")), "SELECT page_id, true AS plain, regexp_full_match(url, '[a-zA-Z0-9_-]+') AS url, false AS uuid FROM pages")
query("path_parts", lambda t: t.documents.select("doc_id", F.expr("concat('/data/', source, '/clip.', doc_id, '.MP4')").alias("p")).select("doc_id", X.basename(F.col("p")).alias("base"), X.stem(F.col("p")).alias("stem"), X.extension(F.col("p")).alias("ext"), X.relative_key(F.col("p"), "/data").alias("key")), "SELECT doc_id, 'clip.' || doc_id || '.MP4' AS base, 'clip.' || doc_id AS stem, 'mp4' AS ext, source || '/clip.' || doc_id || '.MP4' AS key FROM documents")
query("bucket_key", lambda t: t.documents.select("doc_id", F.expr("concat(if(lang = 'en', 's3', 'gs'), '://', source, '/', doc_id)").alias("u")).select("doc_id", X.bucket_and_key(F.col("u"))[0].alias("bucket"), X.bucket_and_key(F.col("u"))[1].alias("key")), "SELECT doc_id, CASE WHEN lang = 'en' THEN source END AS bucket, CASE WHEN lang = 'en' THEN doc_id::VARCHAR END AS key FROM documents")
query("guess_mime", lambda t: t.documents.select("doc_id", X.guess_mime(F.expr("concat('a.', if(lang = 'en', 'MP4', if(lang = 'de', 'png', 'xyz')))")).alias("mime")), "SELECT doc_id, CASE lang WHEN 'en' THEN 'video/mp4' WHEN 'de' THEN 'image/png' ELSE 'application/octet-stream' END AS mime FROM documents")
MEDIA = "case lang when 'en' then concat('data:video/mp4;base64,', doc_id) when 'de' then concat('data:video/mp4;frames,', repeat('x,', 7), 'x') when 'fr' then 'data:image/png;frames,a,b' else text end"
query("media_uri_parse", lambda t: t.documents.select("doc_id", F.expr(MEDIA).alias("u")).select("doc_id", X.media_kind(F.col("u")).alias("kind"), X.media_type(F.col("u")).alias("type"), F.length(X.media_payload(F.col("u"))).cast("long").alias("size"), X.frames_are_whole(F.col("u")).alias("whole")), "SELECT doc_id, CASE lang WHEN 'en' THEN 'base64' WHEN 'es' THEN 'text' ELSE 'frames' END AS kind, CASE lang WHEN 'en' THEN 'video/mp4' WHEN 'de' THEN 'video/mp4' WHEN 'fr' THEN 'image/png' END AS type, CASE lang WHEN 'en' THEN length(doc_id::VARCHAR) WHEN 'de' THEN 15 WHEN 'fr' THEN 3 END AS size, CASE lang WHEN 'es' THEN NULL ELSE lang = 'de' END AS whole FROM documents")
query("media_uri_build", lambda t: t.pages.select("page_id", X.media_uri(F.col("url"), F.when(F.col("page_id") % 2 == 0, "webm")).alias("uri")), "SELECT page_id, 'data:video/' || CASE WHEN page_id % 2 = 0 THEN 'webm' ELSE 'mp4' END || CASE WHEN regexp_matches(url, '^(http|https|ftp|ftps)://.+') THEN ';presigned_url,' ELSE ';base64,' END || url AS uri FROM pages")
query("b64_codec", lambda t: t.documents.select("doc_id", X.encode_b64(F.col("text"), 2000).alias("b")).select("doc_id", F.md5("b").alias("coded"), F.md5(F.unbase64("b")).alias("back")), "SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN md5(base64(encode(text))) END AS coded, CASE WHEN strlen(text) <= 2000 THEN md5(text) END AS back FROM documents")


def vector_codec(t):
    """Vectors to base64 little-endian floats and back."""
    coded = t.embeddings.select("vec_id", V.encode_vectors(F.when(F.col("vec_id") % 5 > 0, F.col("embedding"))).alias("text"))
    return coded.select("vec_id", F.length("text").cast("long").alias("chars"), V.decode_vectors(F.col("text")).alias("back"))


query("vector_codec", vector_codec, "SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN 344 END AS chars, CASE WHEN vec_id % 5 > 0 THEN embedding END AS back FROM embeddings")
query("url_check", lambda t: t.pages.select("page_id", X.is_url(F.col("url")).alias("ok"), X.is_url(F.concat(F.lit("x"), F.col("url"))).alias("bad")), "SELECT page_id, regexp_matches(url, '^(http|https|ftp|ftps)://.+') AS ok, regexp_matches('x' || url, '^(http|https|ftp|ftps)://.+') AS bad FROM pages")
query("s3_path_check", lambda t: t.documents.select("doc_id", X.s3_path_fault(F.expr("concat(if(lang = 'en', 's3://bucket/', if(lang = 'de', 's3://bkt/../', if(lang = 'fr', 'http://', 's3://bkt/*'))), doc_id)")).alias("fault")), "SELECT doc_id, CASE lang WHEN 'de' THEN 'parent folder' WHEN 'fr' THEN 'scheme' WHEN 'es' THEN 'glob or query' END AS fault FROM documents")
query("url_quote", lambda t: t.documents.select("doc_id", X.quote_path(F.concat("source", F.lit("/a b+é/"), "doc_id")).alias("quoted")), "SELECT doc_id, source || '/a%20b%2B%C3%A9/' || doc_id AS quoted FROM documents")
query("text_prep", lambda t: t.documents.select("doc_id", F.md5(X.prepare_text(F.col("text"), "q: ", " ?")).alias("text")), "SELECT doc_id, md5('q: ' || replace(text, chr(10), ' ') || ' ?') AS text FROM documents")
query("word_count", lambda t: t.documents.select("doc_id", X.word_count(F.col("text")).alias("n")), "SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) AS n FROM documents")
query("input_kind", lambda t: t.documents.select("doc_id", X.input_kind(F.expr(MEDIA)).alias("kind")), "SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN 'video' ELSE 'text' END AS kind FROM documents")
query("json_codec", lambda t: t.events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("j"), "props").select("event_id", F.from_json("j", "event_type string, user_id long").alias("s"), F.md5(F.col("props")).alias("props")).select("event_id", "s.event_type", "s.user_id", "props"), "SELECT event_id, event_type, user_id, md5(props) AS props FROM events")
query("fill_nan", lambda t: t.events.select("event_id", X.fill_nan(F.when(F.col("event_id") % 3 == 0, float("nan")).when(F.col("event_id") % 3 == 1, F.col("value"))).alias("value")), "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN value ELSE 0.0 END AS value FROM events")
query("scale_label", lambda t: t.labels.select("doc_id", (F.col("quality") / 10.0).cast("double").alias("scaled")), "SELECT doc_id, quality / 10.0::DOUBLE AS scaled FROM labels")
query("status_name", lambda t: t.events.select("event_id", X.state_name((F.col("event_id") % 9).cast("int")).alias("state")), "SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'started' WHEN 5 THEN 'persisted' WHEN 6 THEN 'completed' WHEN 7 THEN 'failed_and_cleaned' ELSE 'unknown' END AS state FROM events")
query("flag_local_urls", lambda t: t.pages.select("page_id", X.is_local_url(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://localhost:8000/"), F.col("page_id"))).otherwise(F.col("url"))).alias("local")), "SELECT page_id, page_id % 4 = 0 AS local FROM pages")
query(
    "select_by_allow_list",
    lambda t: t.documents.where(filters.allowed_lists(F.when(F.col("lang") == "fr", F.lit("every")).otherwise(F.concat_ws(",", "lang", "source")), ["en", "de", "src0", "src1", "src2"], "every")).select("doc_id"),
    "SELECT doc_id FROM documents WHERE lang = 'fr' OR (lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2'))",
)
def probes(t):
    """Probe results made from parts: a codec, container formats, and a frame size that is unknown for every eleventh."""
    names = F.array(*map(F.lit, (*routing.CODECS, "ffv1", " VP9 ")))
    size = F.when(F.col("p_partkey") % 11 > 0, F.col("p_size") * 100)
    return t.part.select(
        "p_partkey",
        names[(F.col("p_partkey") % 13).cast("int")].alias("codec"),
        F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Matroska"), F.lit("webm"))).otherwise(F.array(F.lit("mp4"))).alias("formats"),
        size.alias("width"),
        (size * 0.5625).cast("int").alias("height"),
    )


def media_split(t):
    good, bad = routing.split_media(probes(t))
    return good.select("p_partkey", F.lit(None).cast("string").alias("fault")).unionByName(bad.select("p_partkey", "fault"))


query(
    "filter_valid_media",
    media_split,
    """SELECT p_partkey, CASE WHEN p_partkey % 13 = 11 THEN 'codec' WHEN p_partkey % 13 IN (8, 12) AND p_size % 3 = 0 THEN 'vp9 container'
WHEN p_partkey % 11 > 0 AND p_size > 40 THEN 'too large' END AS fault FROM part""",
)
