"""Cells of 8-bit codes: approximate search that reads a quarter of the bytes and scores few vectors exactly.

Each block of a cell holds, next to its vectors, codes of one byte a place between the block's lowest and highest value of that
place. A search reads the codes of a query's nearest cells and scores them by one matrix product; a score is off by at most half
a step per place times |query|, so each row has a lowest and a highest score. Rows whose highest score does not reach the k-th
best of the lowest scores of the query are out. Only the others' vectors are read and scored, so the result is that of an exact
search of the same cells, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.operators.search import DOC_BLOCK, STRIP, _blocks, _each, _matrix, _query_blocks, assign_cells, check_k, top_k
from lodestar.session import stored

LEVELS = 255
#: Relative room for the rounding of 32-bit sums, per place.
ROUNDING = 2.0**-22
INDEX = "cell long, block long, ids array<long>, width long, low binary, step binary, codes binary, squares binary, matrix binary"
CANDIDATES = "qid long, cell long, block long, place int, lowest double, highest double"
#: Candidates that are sent to the blocks, at most; more are joined by a shuffle.
MOST_SENT = 1 << 18


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix: the lowest value and the step of each place, and the codes. Stored as 32-bit numbers, so the step has room
    for the rounding of both."""
    low = x.min(axis=0).astype("<f4")
    span = x.max(axis=0) - low.astype(float)
    step = (span / LEVELS * (1 + 1e-6)).astype("<f4")
    safe = np.where(step > 0, step, 1).astype(float)
    codes = np.clip(np.rint((x - low) / safe), 0, LEVELS).astype(np.uint8)
    return low, step, codes


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their codes. A block is known by its first id and cell."""
    for batch in batches:
        for row in batch.to_pylist():
            x = _matrix(row["matrix"], len(row["ids"]), row["width"])
            low, step, codes = encode(x)
            made = {"cell": row["cell"], "block": row["ids"][0], "ids": row["ids"], "width": row["width"], "low": low.tobytes(), "step": step.tobytes()}
            made |= {"codes": codes.tobytes(), "squares": (x * x).sum(axis=1).astype("<f8").tobytes(), "matrix": row["matrix"]}
            kinds = {"ids": pa.list_(pa.int64())} | dict.fromkeys(("low", "step", "codes", "squares", "matrix"), pa.binary())
            yield pa.RecordBatch.from_pydict({c: pa.array([v], kinds.get(c, pa.int64())) for c, v in made.items()})


def build_coded_cells(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index: every document (id, vector) with a vector, in blocks of its cell, coded. Write it, partitioned by cell where
    exact vectors of few cells shall be read."""
    placed = assign_cells(docs.where("vector is not null").select("id", "vector"), centres, 1)
    placed = placed.select("id", F.col("cells")[0].cast("long").alias("cell"), F.lit("").alias("grp"), "vector")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = placed.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "id")
    return _blocks(ranges, "ids", DOC_BLOCK, ["cell"]).mapInArrow(_coded, INDEX)


def _bounds(metric: str, k: int):
    """Blocks of codes and of queries -> per query the rows that may be among the k best of the block, with both bounds of their
    score (for l2, of the negative distance)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            width, qids = row["width"], np.array(row["qids"])
            every = _matrix(row["q_matrix"], len(qids), width)
            low, step = (np.frombuffer(row[c], "<f4").astype(float) for c in ("low", "step"))
            squares = np.frombuffer(row["squares"], "<f8")
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(squares), width).T.astype(np.float32)
            for begin in range(0, len(qids), STRIP):
                q = every[begin : begin + STRIP]
                scaled = q * step
                rough = (scaled.astype(np.float32) @ codes).astype(float) + (q @ low)[:, None]
                size = np.abs(scaled).sum(axis=1) * LEVELS + np.abs(q) @ np.abs(low)
                off = (np.abs(scaled).sum(axis=1) * (0.5 + 1e-3) + size * ROUNDING * (width + 8))[:, None]
                lowest, highest = rough - off, rough + off
                if metric == "cosine":
                    length = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt(squares)[None]
                    with np.errstate(invalid="ignore", divide="ignore"):
                        lowest, highest = lowest / length * (1 + 1e-12), highest / length * (1 + 1e-12)
                    highest[np.isnan(highest)] = np.inf
                    lowest[np.isnan(lowest)] = -np.inf
                elif metric == "l2":
                    far = (q * q).sum(axis=1)[:, None] + squares[None]
                    room = far * 1e-12
                    lowest, highest = 2 * lowest - far - room, 2 * highest - far + room
                n = min(k, len(squares))
                least = -np.partition(-lowest, n - 1, axis=1)[:, n - 1 : n]
                at, place = np.nonzero(highest >= least)
                columns = [pa.array(qids[begin + at])] + [pa.array(np.full(len(at), row[c])) for c in ("cell", "block")]
                columns += [pa.array(place.astype(np.int32)), pa.array(lowest[at, place]), pa.array(highest[at, place])]
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in CANDIDATES.split(", ")])

    return run


def _exact(metric: str):
    """Blocks of vectors with lists of (qid, place, query vector) -> exact scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, width, matrix, wanted = (batch.column(c)[at] for c in ("ids", "width", "matrix", "wanted"))
                ids, asked = ids.values.to_numpy(), wanted.values
                every = _matrix(matrix.as_py(), len(ids), width.as_py())
                for low in range(0, len(asked), DOC_BLOCK):
                    qids, place, vectors = asked.slice(low, DOC_BLOCK).flatten()
                    place = place.to_numpy()
                    x, q = every[place], np.asarray(vectors.flatten().cast(pa.float64())).reshape(len(place), -1)
                    score = np.einsum("ij,ij->i", x, q)
                    if metric == "cosine":
                        with np.errstate(invalid="ignore", divide="ignore"):
                            score /= np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1)
                    elif metric == "l2":
                        score = (q * q).sum(axis=1) + (x * x).sum(axis=1) - 2 * score
                    yield pa.RecordBatch.from_arrays([qids, pa.array(ids[place]), pa.array(score, from_pandas=True)], ["qid", "id", "score"])

    return run


def coded_candidates(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 4, metric: str = "ip") -> DataFrame:
    """qid, cell, block, place, lowest, highest: all rows of the probed cells that may be among a query's k best."""
    q = assign_cells(queries.where("vector is not null").select("qid", "vector"), centres, min(probes, len(centres)))
    q = q.select("qid", F.explode(F.col("cells").cast("array<long>")).alias("cell"), "vector").repartition("cell").sortWithinPartitions("cell")
    near = index.drop("matrix", "ids").join(_query_blocks(q, ["cell"]), "cell")
    found = stored(near.mapInArrow(_bounds(metric, check_k(k)), CANDIDATES))
    kth = top_k(found.select("qid", "block", "place", "lowest"), k, score="lowest", tie="place").groupBy("qid").agg(F.count("*").alias("n"), F.min("lowest").alias("least"))
    return found.join(kth, "qid").where((F.col("n") < k) | (F.col("highest") >= F.col("least"))).drop("n", "least")


def search_coded_cells(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 4, metric: str = "ip") -> DataFrame:
    """qid, id, score, rank: the k nearest in a query's `probes` nearest cells, as an exact search of these cells finds them."""
    found = stored(coded_candidates(index, queries, centres, k, probes, metric))
    asked = found.join(queries.select("qid", "vector"), "qid")
    wanted = asked.groupBy("cell", "block").agg(F.collect_list(F.struct("qid", "place", "vector")).alias("wanted"))
    cells = [r.cell for r in found.select("cell").distinct().collect()]  # at most those probed by the stated queries
    exact = index.where(F.col("cell").isin(cells)).select("cell", "block", "ids", "width", "matrix")
    wanted = F.broadcast(wanted) if found.count() <= MOST_SENT else wanted
    scored = exact.join(wanted, ["cell", "block"]).drop("cell", "block").mapInArrow(_exact(metric), "qid long, id long, score double")
    return top_k(scored, k, largest=V.METRICS[metric][1])
