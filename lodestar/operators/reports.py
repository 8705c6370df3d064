"""Reports over logs of ingest and search: latencies, rates, counters, progress, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.sampling import numbered


def nan_mean(column: Column) -> Column:
    """Mean without NaN and null."""
    return F.avg(F.when(~F.isnan(column), column))


def latency_summary(log: DataFrame) -> DataFrame:
    """min, avg and max latency, successes, and requests per second of latency. log: query, latency, ok."""
    return log.agg(
        F.min("latency").alias("min_latency"),
        F.avg("latency").alias("avg_latency"),
        F.max("latency").alias("max_latency"),
        F.sum("ok").alias("successes"),
        F.try_divide(F.count("*"), F.sum("latency")).alias("per_second"),
    )


def latency_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("query").agg(
        F.count("*").alias("n"), F.min("latency").alias("min_latency"), F.avg("latency").alias("avg_latency"), F.max("latency").alias("max_latency")
    )


def latency_breakdown(log: DataFrame) -> DataFrame:
    """Mean total, baseline and embedding time without NaN, and what is left of the total, at least 0."""
    total, base, embed = (nan_mean(F.col(c)) for c in ("total", "baseline", "embed"))
    rest = F.greatest(F.lit(0.0), total - F.coalesce(base, F.lit(0.0)) - F.coalesce(embed, F.lit(0.0)))
    return log.agg(total.alias("total"), base.alias("baseline"), embed.alias("embed"), rest.alias("search"))


def batch_report(batches: DataFrame) -> DataFrame:
    """batches: items, latency -> number, latencies, time per item and items per second."""
    return batches.agg(
        F.count("*").alias("batches"),
        F.sum("items").alias("items"),
        F.min("latency").alias("min_latency"),
        F.avg("latency").alias("avg_latency"),
        F.max("latency").alias("max_latency"),
        F.try_divide(F.sum("latency"), F.sum("items")).alias("seconds_per_item"),
        F.try_divide(F.sum("items"), F.sum("latency")).alias("items_per_second"),
    )


def status_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.sum("files").alias("files"))


def service_counters(log: DataFrame) -> DataFrame:
    """log: ok (boolean), embeddings, videos, seconds."""
    return log.agg(
        F.count("*").alias("requests"),
        F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.sum("embeddings").alias("embeddings"),
        F.sum("videos").alias("videos"),
        F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("mean_seconds"),
    )


def progress(polls: DataFrame) -> DataFrame:
    """polls: job, ts (seconds), n, target -> rows gained, rate since the previous poll, percent of the target."""
    by_time = Window.partitionBy("job").orderBy("ts")
    gained = F.col("n") - F.lag("n").over(by_time)
    return polls.select(
        "job",
        "ts",
        "n",
        gained.alias("gained"),
        F.try_divide(gained.cast("double"), F.col("ts") - F.lag("ts").over(by_time)).alias("rate"),
        F.try_divide(100.0 * F.col("n"), F.col("target")).alias("percent"),
    )


def queue_positions(requests: DataFrame, queue: str, created: list[Column]) -> DataFrame:
    """Place, from 1, of each pending request in its queue."""
    return numbered(requests.where("status = 'pending'"), queue, created, "position")
