"""Near duplicates among embeddings by an epsilon grid order join.

Method: vectors of unit length with cosine >= c are at most eps = sqrt(2 - 2c) apart, also after projection on leading
principal dimensions. Vectors are sorted by the cells (of side eps) of their projections; the sorted sequence is cut into
intervals, the intervals into blocks, and up to STRIP blocks on end are a strip. Pairs of intervals are joined
recursively, from the whole sequence down to strips and, inside a task, down to blocks and leaves: a pair whose bounding
boxes are more than eps apart is skipped with all below it. What is left at the leaves is compared by cosine in double
precision.

A block is sent once to each pair of strips it is needed in, as 32-bit numbers where these are exact, so what is shuffled
is about (blocks / STRIP) x the vectors where nothing can be skipped; projections are computed again from the vectors.
Equal vectors are one class before the join (by two 64-bit hashes). A pair of strips returns at most one row for each of
its vectors: how many links it has there, and the root of its links there, so a group of m near copies costs m rows, not
m^2.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and keep
themselves. Vectors of different lengths are compared with those of their own length only. A null id gives null
component and kept. Rows that repeat an id and a vector count as links of each other by row. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import connected_components, materialize, shared_folder, small

LEADING = 16
GRID = 8
ROWS = 2048
LEAF = 256
#: Blocks that are joined with those of another strip in one task.
STRIP = 8
FAN = 64
SLACK = 1e-9


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _place(axes: np.ndarray, side: float):
    """Rows (rep, copies, vector) with their projections and the cells of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = _unit(_matrix(batch.column(2))) @ axes
                cells = np.floor(at[:, :GRID] / side).astype(np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]) for x in (at, cells)]
                arrays = [*batch.columns, lists[0].cast(pa.list_(pa.float64())), lists[1].cast(pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["rep", "copies", "vector", "at", "cells"])

    return run


def _packed(vectors: np.ndarray) -> bytes:
    """Numbers of 32 bits where these are exact, else of 64."""
    with np.errstate(over="ignore"):
        narrow = vectors.astype("<f4")
    return (narrow if (narrow == vectors).all() else vectors.astype("<f8")).tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f4" if len(data) == 4 * rows * width else "<f8").reshape(rows, width)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows -> one row per block: part, strip, block, box (lows, then highs), ids, copies, vectors."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        at = _matrix(table["at"].combine_chunks())
        box = np.concatenate([at.min(axis=0), at.max(axis=0)])
        columns = {
            "part": pa.array([part], pa.int64()),
            "strip": pa.array([(part << 24) + number // STRIP], pa.int64()),
            "block": pa.array([(part << 24) + number], pa.int64()),
            "box": pa.array([box.tolist()], pa.list_(pa.float64())),
            "ids": pa.array([table["rep"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "copies": pa.array([table["copies"].to_numpy().astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([_packed(_matrix(table["vector"].combine_chunks()))], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(columns)

    size = 0
    for batch in batches:
        while batch.num_rows:
            piece = batch.slice(0, ROWS - size)
            batch = batch.slice(piece.num_rows)
            held.append(piece)
            size += piece.num_rows
            if size == ROWS:
                yield out(held)
                number, held, size = number + 1, [], 0
    if size:
        yield out(held)


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number reachable from each of n nodes by the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def _leaves(xa: np.ndarray, xb: np.ndarray, same: bool, eps: float) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of intervals (low, high, low, high) of two sorted blocks of projections that boxes don't keep apart."""
    stack = [(0, len(xa), 0, len(xb))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c >= b and a > c:
            continue
        p, q = xa[a:b], xb[c:d]
        gap = np.maximum(0, np.maximum(p.min(axis=0) - q.max(axis=0), q.min(axis=0) - p.max(axis=0)))
        if (gap * gap).sum() > eps * eps + SLACK:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
            continue
        m, n = (a + b) // 2, (c + d) // 2
        left = [(a, m), (m, b)] if b - a > LEAF else [(a, b)]
        right = [(c, n), (n, d)] if d - c > LEAF else [(c, d)]
        stack += [(*x, *y) for x in left for y in right if not same or x[0] <= y[0]]


def _join_strips(axes: np.ndarray, least: float, eps: float):
    """The blocks of a pair of strips -> (vec, links, root): links of each vector within the pair, counting copies."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("block").sort_values("block")
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        blocks, first = [], 0
        for row in pdf.itertuples():
            ids = np.frombuffer(row.ids, "<i8")
            unit = _unit(_unpacked(row.vectors, len(ids), len(axes)))
            blocks.append((row.strip, first, ids, np.frombuffer(row.copies, "<i8"), unit, unit @ axes))
            first += len(ids)
        every = np.concatenate([x[2] for x in blocks])
        links, ends = np.zeros(len(every), np.int64), []
        for k, (strip, p, ids, copies, unit, at) in enumerate(blocks):
            for other, q, ids2, copies2, unit2, at2 in blocks[k:]:
                if {strip, other} != {a, b}:
                    continue
                same, size = p == q, len(ids) + len(ids2)
                place = np.concatenate([p + np.arange(len(ids)), q + np.arange(len(ids2))])
                for low, high, low2, high2 in _leaves(at, at2, same, eps):
                    i, j = np.nonzero(unit[low:high] @ unit2[low2:high2].T >= least)
                    i, j = i + low, j + low2
                    if same:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    np.add.at(links, p + i, copies2[j])
                    np.add.at(links, q + j, copies[i])
                    to = j if same else j + len(ids)
                    found = local_roots(i, to, size)
                    some = np.flatnonzero(found != np.arange(size))
                    ends.append((place[some], place[found[some]]))
        if not ends:
            return pd.DataFrame({"vec": [], "links": [], "root": []}).astype("int64")
        root = local_roots(*(np.concatenate(x) for x in zip(*ends, strict=True)), len(every))
        some = np.flatnonzero(links)
        return pd.DataFrame({"vec": every[some], "links": links[some], "root": every[root[some]]})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    eps = math.sqrt(max(0.0, 2 - 2 * cosine))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sound = "vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    rows = rows.withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), F.reverse("vector")))
    good = rows.where("sound and vec_id is not null")
    copies = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = materialize(copies, folder, "copies")
    single = good.join(small(copies), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), "vector")
    several = good.join(small(copies), ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"]).select(single.columns)
    classes = materialize(single.unionByName(several), folder, "classes")
    widths = [r.w for r in classes.select(F.size("vector").alias("w")).distinct().collect()]
    counted = None
    for width in widths:
        own = classes.where(F.size("vector") == width)
        leading = min(LEADING, width)
        # Lengths are bound to variables, as inside a lambda they would be computed again for every component.
        scaled = "transform(array(array_max(transform(vector, y -> abs(y)))), m -> transform(vector, x -> x / m))[0]"
        unit = "transform(array(sqrt(aggregate(vector, 0D, (s, y) -> s + y * y))), n -> transform(vector, x -> x / n))[0]"
        if own.limit(2).count() < 2:
            continue
        model = PCA(k=leading, inputCol="v", outputCol="p").fit(
            own.select(F.expr(scaled).alias("vector"))
            .select(array_to_vector(F.expr(unit)).alias("v"))
        )
        axes = np.asarray(model.pc.toArray())
        shape = "rep long, copies long, vector array<double>, at array<double>, cells array<int>"
        placed = own.select("rep", "copies", "vector").mapInArrow(_place(axes, max(eps, 1e-6)), shape)
        ordered = placed.repartitionByRange("cells", "rep").sortWithinPartitions("cells", "rep")
        shape = "part long, strip long, block long, box array<double>, ids binary, copies binary, vectors binary"
        blocks = materialize(ordered.mapInArrow(_blocks, shape), folder, f"blocks-{width}")

        boxes = materialize(blocks.select("part", "strip", "box"), folder, f"boxes-{width}")
        pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
        levels = [(f"part div {FAN}", "0"), ("part", f"part div {FAN}"), ("strip", "part")]
        for own_key, parent in levels:
            nodes = boxes.groupBy(F.expr(f"cast({own_key} as long)").alias("node"), F.expr(f"cast({parent} as long)").alias("parent")).agg(
                F.array(*[F.min(F.col("box")[k]) for k in range(leading)], *[F.max(F.col("box")[leading + k]) for k in range(leading)]).alias("box")
            )
            x, y = nodes.toDF("na", "pa", "xa"), nodes.toDF("nb", "pb", "xb")
            gaps = [
                f"pow(greatest(0D, xa[{k}] - xb[{leading + k}], xb[{k}] - xa[{leading + k}]), 2)" for k in range(leading)
            ]
            near = f"na <= nb and {' + '.join(gaps)} <= {eps * eps + SLACK!r}"
            pairs = pairs.join(x, pairs.a == x.pa).join(y, F.col("b") == y.pb).where(near).select(F.col("na").alias("a"), F.col("nb").alias("b"))
        sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("strip")).distinct()
        sent = sides.join(blocks.select("strip", "block", "ids", "copies", "vectors"), "strip")
        joined = sent.groupBy("a", "b").applyInPandas(_join_strips(axes, cosine, eps), "vec long, links long, root long")
        counted = joined if counted is None else counted.unionByName(joined)
    if counted is None:
        counted = spark.createDataFrame([], "vec long, links long, root long")
    counted = materialize(counted, folder, "counted")
    found = connected_components(counted.select(F.col("vec").alias("a"), F.col("root").alias("b")), folder)
    links = counted.groupBy("vec").agg(F.sum("links").alias("links"))
    named = classes.drop("vector").join(links, F.col("rep") == links.vec, "left").join(found, F.col("rep") == found.node, "left")
    named = named.select("h1", "h2", F.expr("copies - 1 + coalesce(links, 0)").alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.drop("vector").join(named.withColumn("sound", F.lit(True)), ["h1", "h2", "sound"], "left")
    known = F.col("vec_id").isNotNull() & F.col("n").isNotNull()
    out = out.select(
        "vec_id",
        F.when(known, F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(known, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
