"""Tables of a data folder, common inputs derived from them, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import search
from lodestar.session import work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries of searches: every row whose id is divisible by this, against all rows.
QUERY_STEP = 50


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def work(self) -> str:
        return work_folder(self.spark)

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    @property
    def queries(self) -> DataFrame:
        return self.embeddings.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))

    @property
    def hits(self) -> DataFrame:
        """qid, id, score, rank: top 10 by inner product."""
        return search.knn_exact(self.vectors, self.queries, 10)

    @property
    def results(self) -> DataFrame:
        """Hits with content and metadata of the document of the same number."""
        meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
        docs = self.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), meta.alias("metadata"))
        return self.hits.join(docs, "id")


#: The same inputs in SQL.
HITS = f"""q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {QUERY_STEP} = 0),
s AS (SELECT qid, vec_id AS id, label, list_inner_product(qv, embedding::DOUBLE[]) AS score FROM q CROSS JOIN embeddings),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10)"""
RESULTS = HITS + ",\nr AS (SELECT h.*, d.text AS content, d.lang, d.source, d.n_chars FROM h JOIN documents d ON d.doc_id = h.id)"


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if sql:
        ORACLE_SQL[name] = sql
