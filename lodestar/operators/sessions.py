"""Joins on time: nearest timestamps and segments of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_timestamp(lookups: DataFrame, rows: DataFrame, width: float = 3600.0) -> DataFrame:
    """Per lookup (lookup_id, session, at) the row (session, ts, id) of its session nearest in time, in seconds.

    Both sides are united and sorted by time within a session's bin of `width` seconds, where each lookup sees the last row
    before and the first after it. What is outside its bin comes from the first and last rows of the session's other bins,
    a table of one row per bin: no pairs are made, and a long session is many tasks. Of two equally near rows the earlier
    wins, of equal times the smallest id.
    """
    firsts = rows.groupBy("session", "ts").agg(F.min("id").alias("id"))
    point = F.struct(F.col("ts"), F.col("id"))
    none = F.lit(None).cast(firsts.select(point.alias("p")).schema[0].dataType)
    both = firsts.select("session", F.col("ts").alias("t"), F.lit(None).cast("long").alias("lookup_id"), point.alias("row")).unionByName(
        lookups.select("session", F.col("at").alias("t"), "lookup_id", none.alias("row"))
    )
    both = both.withColumn("bin", F.floor(F.col("t") / width))
    bins = both.groupBy("session", "bin").agg(F.min("row").alias("low"), F.max("row").alias("high"))
    by_bin = Window.partitionBy("session").orderBy("bin")
    bins = bins.select(
        "session",
        "bin",
        F.last("high", ignorenulls=True).over(by_bin.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("low", ignorenulls=True).over(by_bin.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    order = Window.partitionBy("session", "bin").orderBy("t", F.col("lookup_id").asc_nulls_first())
    past = F.last("row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("row", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("past", past).withColumn("ahead", ahead).where("lookup_id is not null").join(bins, ["session", "bin"])
    near = near.withColumn("past", F.coalesce("past", "earlier")).withColumn("ahead", F.coalesce("ahead", "later"))
    closer = F.when(F.col("past").isNull(), F.col("ahead")).when(F.col("ahead").isNull(), F.col("past"))
    closer = closer.when(F.col("t") - F.col("past.ts") <= F.col("ahead.ts") - F.col("t"), F.col("past")).otherwise(F.col("ahead"))
    return near.withColumn("best", closer).where("best is not null").select("lookup_id", "session", F.col("t").alias("at"), F.col("best.id").alias("id"), F.col("best.ts").alias("ts"))


def segment_join(segments: DataFrame, rows: DataFrame, width: float) -> DataFrame:
    """Rows (session, ts, id) inside segments (segment_id, session, low, high), ends included.

    An equi-join on session and time bins of the given width, so that long sessions are spread; a segment goes to every
    bin it touches.
    """
    spread = F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width)))
    cut = segments.where("low <= high").withColumn("bin", spread)
    placed = rows.withColumn("bin", F.floor(F.col("ts") / width))
    return placed.join(cut, ["session", "bin"]).where("ts between low and high").drop("bin")
