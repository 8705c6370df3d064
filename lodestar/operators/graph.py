"""A graph of near neighbours, built by rounds of joins (NN-descent) and searched by rounds of equi-joins on a frontier.

Building: each vector starts with the nearest of blocks of neighbours along a few random projections. In a round every node
gathers a sample of its neighbours and of the nodes that have it as one, with their vectors; all pairs within that small set are
scored by one matrix product, and each member keeps what is nearer than what it has. Neighbours of neighbours are likely
neighbours, so few rounds are enough; building stops when few links change. Samples are by hashes; nodes that very many
others name give each of them a smaller share, so no group exceeds its bound by much.

Searching: a query starts at the best of a sample of about `entries` nodes. In each round the nodes of its beam (the best found so
far) that have not been followed yet are, and their neighbours are scored exactly. It ends when all of the beam are followed. A
round reads the graph once for all queries, so it suits batches of queries.

The result is approximate: recall depends on degree, beam and data. Rows without a vector are left out; vectors of zeros have a
cosine of 0 here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.search import MOST_SENT as MOST_QUERIES
from lodestar.operators.search import check_k, knn_exact, top_k
from lodestar.session import stored

BLOCK = 64
LINKS = "id long, other long, score double"
#: Frontier rows that are sent to the graph, at most; more are joined by a shuffle.
MOST_SENT = 1 << 19


def _matrix_of(lists: pa.Array, metric: str) -> np.ndarray:
    x = np.asarray(lists.flatten().cast(pa.float64())).reshape(len(lists), -1)
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1)
    return x


def _closeness(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Scores, larger is nearer: inner products of unit vectors, or negative squared distances."""
    score = x @ y.T
    return score if metric == "cosine" else 2 * score - (x * x).sum(axis=1)[:, None] - (y * y).sum(axis=1)[None]


def _links(ids: np.ndarray, x: np.ndarray, most: int, metric: str) -> list[np.ndarray]:
    """The `most` nearest others of each row: ids, other ids, scores."""
    score = _closeness(x, x, metric)
    score[ids[:, None] == ids[None]] = -np.inf
    n = min(most, len(ids) - 1)
    if n < 1:
        return [ids[:0], ids[:0], np.empty(0)]
    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
    at = np.repeat(np.arange(len(ids)), n)
    found = [ids[at], ids[best.ravel()], score[at, best.ravel()]]
    good = np.isfinite(found[2])
    return [c[good] for c in found]


def _projected(width: int, seed: int):
    direction = np.random.default_rng(seed).normal(size=width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                along = np.asarray(batch.column(1).flatten().cast(pa.float64())).reshape(len(batch), -1) @ direction
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(along)], ["id", "vector", "along"])

    return run


def _in_blocks(degree: int, metric: str):
    """Links within blocks of BLOCK rows in the order they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix_of(batch.column(1), metric)
            for low in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _links(ids[low : low + BLOCK], x[low : low + BLOCK], degree, metric)], ["id", "other", "score"])

    return run


def _in_groups(most: int, metric: str):
    """Links within the gathered members (ids and vectors end to end) of each node, as far as they reach the floor of the
    member: the worst score of its links, if it has all it may have. No other could stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for members in batch.column(0):
                rows = members.values
                ids = rows.field("other").to_numpy()
                near = _links(ids, _matrix_of(rows.field("vector"), metric), most, metric)
                order = np.argsort(ids)
                good = near[2] >= rows.field("floor").to_numpy()[order][np.searchsorted(ids, near[0], sorter=order)]
                found.append([c[good] for c in near])
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "other", "score"])

    return run


def _nearest(links: DataFrame, degree: int) -> DataFrame:
    """Of each id the `degree` nearest others. Dealt by id, the links are shuffled once for both steps."""
    once = links.repartition("id").groupBy("id", "other").agg(F.max("score").alias("score"), F.min("age").alias("age"))
    return top_k(once, degree, by="id", tie="other").drop("rank")


def _sampled(links: DataFrame, node: str, other: str, share: int, salt: int) -> DataFrame:
    """About `share` of each node's links at most, by a hash: (node, other)."""
    sizes = links.groupBy(node).agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64(node, other, F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    return links.join(sizes, node).where(draw * F.col("n") < share).select(F.col(node).alias("node"), F.col(other).alias("other"))


def build_graph(docs: DataFrame, degree: int = 16, sample: int = 12, rounds: int = 8, least: float = 0.01, metric: str = "cosine", projections: int = 3) -> tuple[DataFrame, list[float]]:
    """(the graph: id, vector, others; the share of links that changed in each round).

    Building stops after a round that changes less than `least` of the links, or after `rounds`; the shares say which.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"the metric of a graph is cosine or l2, not {metric!r}")
    rows = stored(docs.where("vector is not null").select("id", "vector"))
    first = rows.first()
    if first is None:
        return rows.withColumn("others", F.array().cast("array<long>")), []
    parts = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (8 * BLOCK)))
    shape = f"id long, vector {dict(rows.dtypes)['vector']}, along double"
    starts = []
    for k in range(projections):
        along = rows.mapInArrow(_projected(len(first.vector), k), shape).repartitionByRange(parts, "along").sortWithinPartitions("along", "id")
        starts.append(along.select("id", "vector").mapInArrow(_in_blocks(degree, metric), LINKS))
    links = starts[0]
    for more in starts[1:]:
        links = links.unionByName(more)
    links = stored(_nearest(links.withColumn("age", F.lit(0)), degree))
    changes: list[float] = []
    for n in range(1, rounds + 1):
        ahead, back = _sampled(links, "id", "other", sample, n), _sampled(links, "other", "id", sample, n)
        members = ahead.unionByName(back).unionByName(links.select(F.col("id").alias("node"), F.col("id").alias("other")).distinct()).distinct()
        floors = links.groupBy(F.col("id").alias("other")).agg(F.when(F.count("*") >= degree, F.min("score")).alias("floor"))
        placed = rows.withColumnRenamed("id", "other").join(floors, "other", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        gathered = members.join(placed, "other").groupBy("node").agg(F.collect_list(F.struct("other", "vector", "floor")).alias("members"))
        found = gathered.select("members").mapInArrow(_in_groups(degree // 2, metric), LINKS).withColumn("age", F.lit(n))
        links = stored(_nearest(links.withColumn("age", F.lit(0)).unionByName(found), degree))
        sums = links.agg(F.avg((F.col("age") == n).cast("double")).alias("changed")).first()
        changes.append(round(sums.changed or 0.0, 4))
        if changes[-1] < least:
            break
    others = links.groupBy("id").agg(F.collect_list("other").alias("others"))
    return rows.join(others, "id", "left").withColumn("others", F.coalesce("others", F.array().cast("array<long>"))), changes


def _scored(metric: str):
    """Rows (qid, id, q_vector, vector) -> qid, id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q, x = _matrix_of(batch.column(2), metric), _matrix_of(batch.column(3), metric)
                score = np.einsum("ij,ij->i", q, x) if metric == "cosine" else -((q - x) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["qid", "id", "score"])

    return run


def search_graph(graph: DataFrame, queries: DataFrame, k: int = 10, beam: int = 48, entries: int = 1024, metric: str = "cosine", most_rounds: int = 50) -> tuple[DataFrame, int]:
    """(qid, id, score, rank; the number of rounds). score: cosine, or squared distance for l2. A search that is not finished
    after most_rounds is an error, not a shorter result."""
    if beam < check_k(k):
        raise ValueError("the beam must hold k")
    asked = stored(queries.where("vector is not null").select("qid", F.col("vector").alias("q_vector")))
    asked = F.broadcast(asked) if asked.count() <= MOST_QUERIES else asked
    share = min(1.0, entries / max(1, graph.count()))
    drawn = graph.where(F.pmod(F.xxhash64("id", F.lit("entry")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("id", "vector")
    begun = knn_exact(drawn, queries, beam, metric).select("qid", "id", "score")
    known = stored(begun.withColumn("score", F.when(F.col("score").isNull() | F.isnan("score"), 0.0).otherwise(F.col("score") if metric == "cosine" else -F.col("score"))).withColumn("followed", F.lit(False)))
    rounds = 0
    while True:
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        ranked = stored(known.withColumn("place", F.row_number().over(best)).withColumn("front", (F.col("place") <= beam) & ~F.col("followed")))
        front = ranked.where("front").select("qid", "id")
        waiting = front.count()
        if not waiting:
            break
        if rounds == most_rounds:
            raise RuntimeError(f"{waiting} nodes are still to be followed after {rounds} rounds")
        rounds += 1
        sent = F.broadcast(front) if waiting <= MOST_SENT else front
        near = graph.select("id", "others").join(sent, "id").select("qid", F.explode("others").alias("id")).distinct()
        new = stored(near.join(ranked.select("qid", "id"), ["qid", "id"], "left_anti"))
        to_score = F.broadcast(new) if new.count() <= MOST_SENT else new
        pairs = graph.select("id", "vector").join(to_score, "id").join(asked, "qid").select("qid", "id", "q_vector", "vector")
        scored = pairs.mapInArrow(_scored(metric), "qid long, id long, score double")
        known = ranked.select("qid", "id", "score", (F.col("followed") | F.col("front")).alias("followed")).unionByName(scored.withColumn("followed", F.lit(False)))
    hits = ranked.where(F.col("place") <= k).select("qid", "id", F.col("score") if metric == "cosine" else (-F.col("score")).alias("score"), F.col("place").alias("rank"))
    return hits, rounds
