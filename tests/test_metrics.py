"""Metrics whose relevance is a label, against those of a table of relevant pairs."""

import pytest
from pyspark.sql import functions as F

from lodestar.operators import metrics
from lodestar.plans import catalog


def test_labels_and_pairs_give_equal_metrics(spark):
    records = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 4).alias("label"))
    queries = spark.range(0, 60, 5).select(F.col("id").alias("qid"))
    hits = queries.crossJoin(spark.range(1, 13).select(F.col("id").alias("rank"))).withColumn("id", F.pmod(F.col("qid") * 3 + F.col("rank") * 11, F.lit(60)))
    asked = queries.join(records.withColumnRenamed("id", "qid"), "qid")
    pairs = asked.join(records, "label").select("qid", "id")
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(metrics.per_query_of_classes(queries, hits, records, 10)) == plain(metrics.per_query(queries, hits, pairs, 10))
    by_label = {(r.qid, r.id): r.rel for r in metrics.class_relevance(hits, records.unionByName(records)).collect()}
    by_pair = {(r.qid, r.id): r.rel for r in metrics.relevance_join(hits, pairs).collect()}
    assert {k: bool(v) for k, v in by_label.items()} == by_pair and None in by_label.values()


def test_a_label_of_many_members_makes_no_pairs(spark):
    """Of one label, 800 million pairs."""
    records = spark.range(200_000).withColumn("label", F.lit(1))
    queries = spark.range(0, 200_000, 50).select(F.col("id").alias("qid"))
    hits = queries.select("qid", F.col("qid").alias("id"), F.lit(1).alias("rank"))
    row = metrics.bundle_of_classes(queries, hits, records, 10).first()
    assert row.n_queries == row.total_hits == 4000 and row.mrr == 1 and row.true_recall == pytest.approx(1 / 200_000)


@pytest.mark.parametrize("name", ["relevance_join", "first_relevant_rank"])
def test_relevance_is_not_joined_by_label(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any("Join" in line and "label" in line for line in plan.splitlines())


def rows_of_joins(plan):
    """The rows that each join of a plan that has run put out."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from rows_of_joins(plan.executedPlan())
        return
    if "Join" in plan.getClass().getSimpleName():
        yield plan.metrics().get("numOutputRows").get().value()
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        yield from rows_of_joins(plan.plan())
    for k in range(plan.children().size()):
        yield from rows_of_joins(plan.children().apply(k))


@pytest.mark.parametrize("name", ["relevance_join", "metric_per_query", *(f"metric_{m}" for m in ("f1_at_k", "mrr", "ndcg", "precision_at_k", "recall_at_k"))])
def test_no_join_of_a_metric_makes_the_pairs_of_a_label(spark, tmp_path, name):
    """80 queries of a label of 2667 members, which are 213,360 pairs, among 4000 vectors."""
    angle, label = F.col("id") * 0.001, F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 3).cast("int")
    made = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.cos(angle), F.sin(angle)).cast("array<float>").alias("embedding"), label.alias("label"))
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.collect()
    joins = list(rows_of_joins(df._jdf.queryExecution().executedPlan()))
    assert len(joins) >= 2 and max(joins) <= 4000


def rows_scored(plan):
    """The rows that tasks which score blocks gave back, of a plan that has run."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return rows_scored(plan.executedPlan())
    own = plan.metrics().get("pythonNumRowsReceived").get().value() if plan.getClass().getSimpleName() == "MapInArrowExec" else 0
    below = [plan.children().apply(k) for k in range(plan.children().size())]
    return own + sum(map(rows_scored, [*below, *([plan.plan()] if plan.getClass().getSimpleName().endswith("QueryStageExec") else [])]))


@pytest.mark.parametrize("name", ["metric_mrr", "metric_ndcg", "metric_per_query", "metric_precision_at_k", "metric_recall_at_k"])
def test_copies_do_not_all_leave_a_block(spark, tmp_path, name):
    """80 queries and 4000 copies, of which all 320,000 pairs left the block."""
    made = spark.range(0, 4000, 1, 1).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), (F.col("id") % 3).cast("int").alias("label"))
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalog.QUERIES[name](spark, str(tmp_path))
    assert df.collect() and 800 <= rows_scored(df._jdf.queryExecution().executedPlan()) <= 80 * 10 * 2
