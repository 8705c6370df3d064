"""Exact search that skips blocks which cannot hold a hit.

Documents lie in blocks of a cell. A block knows a centre and a radius that holds all of its vectors (of their directions, for
cosine), so by the triangle inequality no vector of it scores above a bound for a query. A range search meets the blocks whose
bound reaches the least score. A top-k search first scores each query against its most promising blocks; their k-th best score
is what the bound of any other block must reach. The result is that of a search of all rows; how much is skipped depends on how
clustered the rows are, and pairs_met() says how much.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators.search import DOC_BLOCK, _block_scores, _blocks, _matrix, _query_blocks, assign_cells, check_k, knn_exact, top_k
from lodestar.session import stored

ROWS = 512
BALLS = "cell long, block long, ids array<long>, width long, centre binary, radius double, matrix binary"
#: Blocks that a query meets first.
FIRST = 2
#: Rows of the sample that bounds a grouped search from below.
GROUP_SAMPLE = 100_000
MOST_SENT = 1 << 18


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _balls(metric: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["matrix"], len(row["ids"]), row["width"])
                x = _unit(x) if metric == "cosine" else x
                centre = x.mean(axis=0)
                made = {"cell": row["cell"], "block": row["ids"][0], "ids": row["ids"], "width": row["width"], "centre": centre.astype("<f8").tobytes()}
                made |= {"radius": float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())), "matrix": row["matrix"]}
                kinds = {"ids": pa.list_(pa.int64()), "centre": pa.binary(), "matrix": pa.binary(), "radius": pa.float64()}
                yield pa.RecordBatch.from_pydict({c: pa.array([v], kinds.get(c, pa.int64())) for c, v in made.items()})

    return run


def build_balls(docs: DataFrame, centres: np.ndarray, metric: str = "ip", rows: int = ROWS) -> DataFrame:
    """The index of documents (id, vector) for a metric; block names are the first ids of blocks, so ids must be distinct."""
    placed = assign_cells(docs.where("vector is not null").select("id", "vector"), centres, 1)
    placed = placed.select("id", F.col("cells")[0].cast("long").alias("cell"), F.lit("").alias("grp"), "vector")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = placed.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    return _blocks(ranges, "ids", rows, ["cell"]).mapInArrow(_balls(metric), BALLS)


def _reach(metric: str):
    """Centres and radii with a block of queries -> for each query and block the highest score (for l2 negated) it can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["width"] != row["q_width"]:
                    raise ValueError(f"query vectors have {row['q_width']} components, documents {row['width']}")
                q = _matrix(row["q_matrix"], len(row["qids"]), row["width"])
                q = _unit(q) if metric == "cosine" else q
                c, r = np.frombuffer(row["centre"], "<f8"), row["radius"]
                length = np.linalg.norm(q, axis=1)
                if metric == "l2":
                    best = -(np.maximum(np.linalg.norm(q - c, axis=1) - r, 0) ** 2)
                    best += 1e-9 * (length + np.linalg.norm(c) + r) ** 2
                else:
                    best = q @ c + length * r + 1e-9 * length * (np.linalg.norm(c) + r)
                yield pa.RecordBatch.from_arrays([pa.array(row["qids"], pa.int64()), pa.array([row["block"]] * len(q), pa.int64()), pa.array(best)], ["qid", "block", "best"])

    return run


def reaches(index: DataFrame, queries: DataFrame, metric: str = "ip") -> DataFrame:
    """qid, block, best: no vector of the block scores higher (for l2: minus its distance) for the query."""
    bounds = index.select("block", "width", "centre", "radius")
    return bounds.crossJoin(_query_blocks(queries.where("vector is not null"))).mapInArrow(_reach(metric), "qid long, block long, best double")


def _meet(metric: str, k: int | None):
    """Blocks with the queries they meet (wanted: qid, vector, least) -> scores that reach `least`, of each query the k best
    of the block and all that tie with them. Scores are those of the metric."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row["matrix"], len(row["ids"]), row["width"])
                q = np.array([w["vector"] for w in row["wanted"]], float)
                score = q @ x.T
                if metric == "cosine":
                    with np.errstate(invalid="ignore", divide="ignore"):
                        score /= np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
                elif metric == "l2":
                    score = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * score
                near = -score if metric == "l2" else score
                least = np.array([-np.inf if w["least"] is None else w["least"] for w in row["wanted"]])[:, None]
                lost = np.isnan(near)
                near = np.where(lost, -np.inf, near)
                good = (near >= least) if k is None else (near >= np.maximum(least, -np.partition(-near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1 : min(k, len(x))]))
                good = good & ~lost if k is None else good
                at, best = np.nonzero(good)
                columns = [pa.array(np.array([w["qid"] for w in row["wanted"]], np.int64)[at]), pa.array(np.array(row["ids"], np.int64)[best]), pa.array(score[at, best], from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "id", "score"])

    return run


def _met(index: DataFrame, pairs: DataFrame, queries: DataFrame, metric: str, k: int | None) -> DataFrame:
    """Scores of the pairs (qid, block, least) of queries and blocks."""
    asked = pairs.join(queries.select("qid", "vector"), "qid").groupBy("block").agg(F.collect_list(F.struct("qid", "vector", "least")).alias("wanted"))
    return index.select("block", "ids", "width", "matrix").join(asked, "block").drop("block").mapInArrow(_meet(metric, k), "qid long, id long, score double")


def range_pruned(index: DataFrame, queries: DataFrame, least: float, metric: str = "ip") -> DataFrame:
    """qid, id, score of all pairs of at least a score (l2: at most a distance)."""
    floor = -least if metric == "l2" else least
    pairs = reaches(index, queries, metric).where(F.col("best") >= floor).select("qid", "block", F.lit(float(floor)).alias("least"))
    return _met(index, pairs, queries, metric, None)


def pairs_met(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    """qid, block, least, first: the pairs of queries and blocks that a top-k search meets; `first` are met to set the bound."""
    ranked = stored(reaches(index, queries, metric).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "block"))))
    begun = ranked.where(F.col("place") <= FIRST).select("qid", "block", F.lit(None).cast("double").alias("least"))
    near = F.col("score") if V.METRICS[metric][1] else -F.col("score")
    some = top_k(_met(index, begun, queries, metric, k), k, largest=V.METRICS[metric][1])
    floors = some.groupBy("qid").agg(F.count("score").alias("n"), F.min(near).alias("floor")).where(F.col("n") == k)
    floors = floors.select("qid", (F.col("floor") - F.abs("floor") * 1e-12).alias("least"))
    return ranked.join(floors, "qid", "left").where(F.col("least").isNull() | (F.col("best") >= F.col("least"))).select("qid", "block", "least")


def knn_pruned(index: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    """qid, id, score, rank: the k nearest of all rows."""
    pairs = stored(pairs_met(index, queries, check_k(k), metric))
    return top_k(_met(index, pairs, queries, metric, k), k, largest=V.METRICS[metric][1])


# --- grouped search


def _groups_above(metric: str):
    """A block of documents and one of queries with floors -> per query and group the best document, if it reaches the floor."""
    scores = _block_scores(metric)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = batch.column(batch.schema.get_field_index("floors")).to_pylist()
            rest = batch.drop_columns(["floors"])
            for floor, (ids, qids, groups, score) in zip(floors, scores([rest]), strict=True):
                near = -score if metric == "l2" else score
                near = np.where(np.isnan(near), -np.inf, near)
                least = np.array([-np.inf if f is None else f for f in floor])
                names, group = np.unique(np.array(groups, dtype=object).astype(str), return_inverse=True)
                order = np.lexsort((ids, group))
                firsts = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
                for row in np.flatnonzero((near >= least[:, None]).any(axis=1)):
                    own = near[row][order]
                    top = np.maximum.reduceat(own, firsts)
                    of = group[order]
                    place = np.flatnonzero((own == top[of]) & (own >= least[row]))
                    place = place[np.unique(of[place], return_index=True)[1]]  # of a group's ties the smallest id
                    chosen = order[place]
                    columns = [pa.array(np.full(len(chosen), qids[row])), pa.array(ids[chosen]), pa.array(names[group[chosen]].astype(str), pa.string()), pa.array(score[row, chosen], from_pandas=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["qid", "id", "grp", "score"])

    return run


def group_rows(docs: DataFrame, queries: DataFrame, field: str, k: int, metric: str = "ip", sample: int = GROUP_SAMPLE) -> DataFrame:
    """qid, id, grp, score: what leaves the blocks of a grouped search: groups that may be among the k best.

    A sample of rows is searched first. The k-th best group of a sample is no better than that of all rows, so it bounds every
    query from below, and blocks emit only groups above it: about k rows / sample a query, not a row for each group.
    """
    rows = docs.where("vector is not null").select("id", F.coalesce(F.col(field).cast("string"), F.lit("")).alias("grp"), "vector")
    share = min(1.0, sample / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit("group")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    some = top_k(knn_exact(drawn, queries, 1, metric, group="grp").drop("rank"), k, largest=V.METRICS[metric][1])
    near = F.col("score") if V.METRICS[metric][1] else -F.col("score")
    floors = some.groupBy("qid").agg(F.count("score").alias("n"), F.min(near).alias("floor")).where(F.col("n") == k)
    floors = stored(floors.select("qid", (F.col("floor") - F.abs("floor") * 1e-12).alias("floor")))
    asked = _query_blocks(queries)
    # the floors of a block of queries, in its order
    placed = asked.select(F.posexplode("qids").alias("at", "qid"), F.xxhash64("qids").alias("of")).join(floors, "qid", "left")
    lists = placed.groupBy("of").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "floor"))), lambda x: x["floor"]).alias("floors"))
    asked = asked.withColumn("of", F.xxhash64("qids")).join(lists, "of").drop("of")
    d = _blocks(rows, "ids", DOC_BLOCK)
    return d.crossJoin(asked).mapInArrow(_groups_above(metric), "qid long, id long, grp string, score double")


def group_best_pruned(docs: DataFrame, queries: DataFrame, field: str, k: int, metric: str = "ip", sample: int = GROUP_SAMPLE) -> DataFrame:
    """qid, id, the field, score, rank: per query the best document of each value of a field, then the k best of those."""
    largest = V.METRICS[metric][1]
    best = top_k(group_rows(docs, queries, field, k, metric, sample), 1, by=["qid", "grp"], largest=largest).drop("rank").withColumnRenamed("grp", field)
    return top_k(best, k, largest=largest)
