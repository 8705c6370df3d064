"""Samples, batches, splits, folds and patches with results that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import stored


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place, from 1, of each row in its group by order: for few groups that may be very large.

    Rows are dealt by ranges of group and order and written; a row's place is the number of its group's rows in earlier
    ranges and its place in its own one. So a group is shared by many tasks, and only counts per range meet in one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(df.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_in")).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy("_group").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_group", "_in", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    placed = ranges.withColumn("_here", here)
    joined = placed.join(offsets, placed[group].eqNullSafe(offsets["_group"]) & (placed["_range"] == offsets["_in"]))
    return joined.select(*df.columns, (F.col("_before") + F.col("_here")).alias(name))


def uniform_rows(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each group spread evenly over its order, sample 0..n-1; short groups repeat rows."""
    sized = df.withColumn("_row", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    sized = sized.withColumn("_size", F.count("*").over(Window.partitionBy(group)))
    samples = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("sample"), _spread(i, F.col("_size"), n).alias("at"))),
        lambda s: s["at"] == F.col("_row"),
    )
    return sized.withColumn("_s", F.explode(samples)).withColumn("sample", F.col("_s.sample")).drop("_s", "_row", "_size")


def _spread(i: Column, size: Column, n: int) -> Column:
    step = (size - 1) / F.lit(float(max(1, n - 1)))
    return F.least(F.floor(i * step), size - 1)


def step_rows(df: DataFrame, group: str, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(every (size div n)-th row of each group, the first n of them; the groups of fewer than n rows)."""
    sized = df.withColumn("_row", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    sized = sized.withColumn("_size", F.count("*").over(Window.partitionBy(group)))
    step = F.expr(f"_size div {n}")
    good = sized.where(F.col("_size") >= n).where((F.pmod(F.col("_row"), step) == 0) & (F.col("_row") < step * n))
    short = sized.where(F.col("_size") < n).select(group).distinct()
    return good.drop("_row", "_size"), short


def assign_batches(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """Batch number (from 0) of each row within its group by order."""
    return numbered(df, group, order, "_place").withColumn("batch", F.floor((F.col("_place") - 1) / size)).drop("_place")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def split_validation(df: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """df with `part`: in an order drawn by the seed, exactly the first share of the rows (rounded down) is validation, the others
    are training."""
    placed = _drawn(df, key, seed)
    first = int(df.count() * share)
    return placed.withColumn("part", F.when(F.col("_place") <= first, "validation").otherwise("training")).drop("_place")


def worker_shares(df: DataFrame, key: str, workers: int, seed: int = 0) -> DataFrame:
    """df with `worker` 0..workers-1: rows in an order drawn by the seed are dealt one to each in turn."""
    return _drawn(df, key, seed).withColumn("worker", F.pmod(F.col("_place") - 1, F.lit(workers)).cast("int")).drop("_place")


def _drawn(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `_place`, from 1, in an order drawn by the seed."""
    placed = numbered(df.withColumn("_all", F.lit(0)), "_all", [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "_place")
    return placed.drop("_all")


def stratified_folds(df: DataFrame, label: str, order: list[Column], k: int) -> DataFrame:
    """df with `fold` 0..k-1, balanced within each label."""
    return numbered(df, label, order, "_place").withColumn("fold", F.pmod(F.col("_place") - 1, F.lit(k))).drop("_place")


def patch_grid(images: DataFrame, grids: list[tuple[int, int]]) -> DataFrame:
    """Each image (id) times the cells of the grids (columns, rows): patch_id, bbox_x, bbox_y, bbox_w, bbox_h."""
    boxes = [
        F.struct(F.lit(c / x).alias("bbox_x"), F.lit(r / y).alias("bbox_y"), F.lit(1.0 / x).alias("bbox_w"), F.lit(1.0 / y).alias("bbox_h"))
        for x, y in grids
        for r in range(y)
        for c in range(x)
    ]
    cut = images.select(F.col("id").alias("source_id"), F.posexplode(F.array(*boxes)).alias("patch_id", "box"))
    return cut.select("source_id", "patch_id", "box.*")


def crop_patches(pixels: DataFrame) -> DataFrame:
    """Crops of images: rows (source_id, patch_id, bbox_*, width, height, channels, data) with raw pixels -> data of the
    patch, width and height of it. Corners are rounded down."""
    shape = "source_id string, patch_id int, width int, height int, data binary"

    def crop(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
                x, y = int(r.bbox_x * r.width), int(r.bbox_y * r.height)
                part = image[y : y + int(r.bbox_h * r.height), x : x + int(r.bbox_w * r.width)]
                rows.append((r.source_id, r.patch_id, part.shape[1], part.shape[0], part.tobytes()))
            yield pd.DataFrame(rows, columns=["source_id", "patch_id", "width", "height", "data"])

    return pixels.mapInPandas(crop, shape)
