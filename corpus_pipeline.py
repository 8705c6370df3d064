"""A corpus pipeline of five operators over `documents`.

1. language: documents without a recognizable language go; a missing lang is filled in.
2. near_duplicates: of each group of near duplicates the document of the smallest doc_id stays (of several of that
   doc_id, the one whose text's hash is smallest, and one row of it). Texts without words are no duplicates.
3. secrets: secrets are replaced by [SECRET] in the texts; digests of the usual lengths are left alone.
4. mixture: nine tenths of the tokens, by the weights of domain, language and source; at most one epoch. Each row is taken
   or left by itself: those without a doc_id, and those that share one, are told apart by a number of their own.
5. packing: the texts as pieces of sequences of at most 2048 tokens (columns of the packing operator).

All but the last return the columns they got, whatever those are called: columns that a stage needs for itself get names
that are free. Edge cases are those of the operators; rows with a null doc_id pass the
second stage and are mixed like others. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import language, mixture, packing, queries, secrets
from lodestar.llm.ngram_join import near_duplicate_components
from lodestar.llm.shared import free_name, materialize, shared_folder, small
from lodestar.session import ship


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = language.learn(docs.where(~held_out))
    own = free_name(docs, "_language")
    found = language.identify(docs, model, into=own).where(F.col(own)["lang"] != "und")
    return found.withColumn("lang", F.coalesce("lang", F.col(own)["lang"])).select(docs.columns)


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = free_name(docs, "text_hash")
    classes = near_duplicate_components(docs, text_hash=True).where("doc_id is not null").withColumnRenamed("text_hash", own)
    folder, row = shared_folder(spark), ["doc_id", own]
    others = materialize(classes.where("not first").select(row).distinct(), folder, "others")
    copies = classes.where("first and n_shingles > 0").groupBy(row).count().where("count > 1").select(row)
    copies = small(materialize(copies, folder, "copies"))
    kept = docs.withColumn(own, F.xxhash64("text")).join(small(others), row, "left_anti")
    once = kept.join(copies, row, "left_semi").dropDuplicates(row)
    return kept.join(copies, row, "left_anti").unionByName(once).select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = secrets.redact(docs, queries.tokenizer("byte_bpe_50k.tiktoken"))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def keep_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    total, row = F.floor(F.col("tokens") * 9 / 10), free_name(docs, "_row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), shared_folder(spark), "rows")
    taken = mixture.mix(rows, queries.mixture_levels(), queries.mixture_weights(), total, max_epochs=1, row=row)
    return rows.join(taken.select(row), row, "left_semi").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"), with_ids=False).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", keep_languages),
    ("near_duplicates", keep_representatives),
    ("secrets", hide_secrets),
    ("mixture", keep_mixture),
    ("packing", pack),
]

#: The stages hash shingles, learn a model and run a tokenizer, which SQL cannot say; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on sf_dir's documents; each stage is written and read again."""
    ship(spark)
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), folder, name)
    return docs
