"""Queries of the training-data operators and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import alignment, archives, chat, fingerprint, language, mixture, neighbours, packing, runs, secrets, shards, substrings
from lodestar.llm.ngram_join import near_duplicate_components
from lodestar.llm.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    from public_tokenizers import path

    return path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    return fingerprint.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: set size and component under 5-word shingles with a similarity of 0.75 or more."""
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to ZIP-packaged archives and read back by range."""
    return archives.archive_round_trip(spark, table(spark, sf_dir, "pages")).drop("url")


def op4_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings: links at cosine 0.95 or more and their components."""
    return neighbours.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back from the formatted examples."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.expand(rows))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def mixture_levels() -> dict:
    """Domain (the source's number mod 4), language and source of documents."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1)
    domain = F.concat(F.lit("domain"), F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("long") % 4, F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixture_weights() -> dict:
    """Weights of nodes: domains 4, 3, 2, 1; English 5, other languages 2; sources alike."""
    domain = F.lit(4) - F.substring("domain", 7, 1).cast("long")
    return {"domain": domain, "lang": F.when(F.col("lang") == "en", 5).otherwise(2)}


def op6_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to as many tokens as there are, up to 4 epochs: one row per document and epoch taken."""
    mixed = mixture.mix(table(spark, sf_dir, "documents"), mixture_levels(), mixture_weights(), F.col("tokens"))
    return mixture.epochs_of(mixed)


def op10_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, appended in four arrivals, compacted after each, and read from the newest manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, shared_folder(spark), docs.schema)
    for k in range(4):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == k))
        store.compact()
        store.vacuum(older_than=0)  # nobody else knows this folder
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' languages, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: counts of base spans, their digest, and all spans."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("byte_bpe_50k.tiktoken"))
    n = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    return found.select(
        "doc_id", *n, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans")
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, one in ten made periodic: the runs of each as numbers and digests."""
    return runs.digests(runs.periodic_runs(table(spark, sf_dir, "documents"), edited=True))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: tokens of a byte-level and a piece vocabulary, their groups and links."""
    return alignment.align_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 35 words or more that stand anywhere else."""
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [list_aggregate(ws, 'string_agg', ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i+4], 'string_agg', ' '))) END AS sh
  FROM w),
e AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
f AS (SELECT h FROM e GROUP BY h HAVING count(*) > 1),
g AS (SELECT e.doc_id, e.h FROM e JOIN f USING (h)),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY ALL),
n AS (SELECT doc_id, len(sh) AS n FROM s),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS src, doc_id AS dst FROM n UNION SELECT r.src, u.b FROM r JOIN u ON u.a = r.dst)
SELECT n.doc_id, n.n AS n_shingles, m.component_id
FROM n JOIN (SELECT src, min(dst) AS component_id FROM r GROUP BY src) m ON m.src = n.doc_id
"""

OP3_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP4_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id
      AND list_cosine_similarity(x.e, y.e) >= 0.95),
r AS (SELECT vec_id AS src, vec_id AS dst FROM v UNION SELECT r.src, l.b FROM r JOIN l ON l.a = r.dst)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v JOIN (SELECT src, min(dst) AS c FROM r GROUP BY src) m ON m.src = v.vec_id
"""

OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<|\[)(/?s>|/?INST\])', '\1\\\2', 'g') AS e0,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM rows),
f AS (
  SELECT *, CASE WHEN role = 'assistant' THEN '<s>' || role || chr(10) || e0 || '</s>'
    ELSE '<s>[INST] ' || role || chr(10) || e0 || ' [/INST]</s>' END AS part FROM t),
c AS (SELECT *, sum(length(part)) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

LEVEL_SQL = """
SELECT {up}, w.{name}, w.capacity, w.weight, w.budget FROM (
  SELECT *, CASE WHEN full_ THEN capacity WHEN all_weight = 0 THEN 0
    ELSE (upto_weight * rest) // all_weight - ((upto_weight - weight) * rest) // all_weight END::BIGINT AS budget FROM (
    SELECT *, parent_budget - coalesce(sum(capacity) FILTER (full_) OVER (PARTITION BY {up}), 0)::BIGINT AS rest,
      coalesce(sum(weight) FILTER (NOT full_) OVER (PARTITION BY {up}), 0)::BIGINT AS all_weight,
      coalesce(sum(weight) FILTER (NOT full_) OVER (PARTITION BY {up} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS upto_weight FROM (
      SELECT *, bool_and(own) OVER (PARTITION BY {up} ORDER BY ratio, {name} ROWS UNBOUNDED PRECEDING) AS full_ FROM (
        SELECT *, capacity / weight::DOUBLE AS ratio, capacity * sum(weight) OVER (PARTITION BY {up} ORDER BY capacity / weight::DOUBLE, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
          <= weight * (parent_budget - coalesce(sum(capacity) OVER (PARTITION BY {up} ORDER BY capacity / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS own FROM ({nodes}))))) w
"""

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, 'domain' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) AS domain, lang, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT 0 AS root, domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
l1 AS ({LEVEL_SQL.format(up="root", name="domain", nodes="SELECT root, domain, 4 * sum(tokens)::BIGINT AS capacity, 4 - substr(domain, 7, 1)::BIGINT AS weight, (SELECT sum(tokens) FROM leaf)::BIGINT AS parent_budget FROM leaf GROUP BY ALL")}),
l2 AS ({LEVEL_SQL.format(up="domain", name="lang", nodes="SELECT n.*, l1.budget AS parent_budget FROM (SELECT domain, lang, 4 * sum(tokens)::BIGINT AS capacity, CASE WHEN lang = 'en' THEN 5 ELSE 2 END AS weight FROM leaf GROUP BY ALL) n JOIN l1 USING (domain)")}),
l3 AS ({LEVEL_SQL.format(up="domain, lang", name="source", nodes="SELECT n.*, l2.budget AS parent_budget FROM (SELECT domain, lang, source, 4 * sum(tokens)::BIGINT AS capacity, 1 AS weight FROM leaf GROUP BY ALL) n JOIN l2 USING (domain, lang)")}),
plan AS (
  SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs, CASE WHEN tokens = 0 THEN budget ELSE budget % tokens END AS rest
  FROM l3 JOIN leaf USING (domain, lang, source)),
p AS (SELECT d.*, epochs, rest, md5('17:' || (epochs + 1) || ':' || doc_id) AS key FROM d JOIN plan USING (domain, lang, source)),
s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p)
SELECT doc_id, domain, lang, source, tokens, unnest(range(1, epochs + 1)) AS epoch, tokens AS taken FROM s
UNION ALL SELECT doc_id, domain, lang, source, tokens, epochs + 1, least(tokens, rest - start) FROM s WHERE start < rest
"""

OP10_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (
  SELECT r, unnest(list_transform(range(1, len(ws) - 33), lambda i: {'i': i, 'h': md5(array_to_string(ws[i:i+34], ' '))}), recursive := true)
  FROM w WHERE len(ws) >= 35),
f AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM g JOIN f USING (h)),
t AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM t ANTI JOIN c USING (r, k) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_ngram_join": op2_ngram_join,
    "op3_warc": op3_warc,
    "op4_epsilon_grid": op4_epsilon_grid,
    "op5_chat_format": op5_chat_format,
    "op6_hierarchical_mix": op6_hierarchical_mix,
    "op7_cost_packing": op7_cost_packing,
    "op8_language_spans": op8_language_spans,
    "op9_secret_scan": op9_secret_scan,
    "op10_tiered_shards": op10_tiered_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_alignment": op12_token_alignment,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {
    "op2_ngram_join": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op4_epsilon_grid": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op6_hierarchical_mix": OP6_SQL,
    "op10_tiered_shards": OP10_SQL,
    "op13_substring_dedup": OP13_SQL,
}
