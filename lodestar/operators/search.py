"""Vector search: exact and clustered top-k, ranking, fusion and the shape of results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.session import stored

MOST_K = 16_000
QUERY_BLOCK = 1024
DOC_BLOCK = 4096
#: Queries of a block that are scored at once, so that the scores of a task are 4 MB at a time.
STRIP = 128
#: Blocks of each side that one task scores, about: 64 pairs of blocks leave it 655,360 rows at most of the 10 best.
TASK_BLOCKS = 8
#: Bits of the place of a pair among those that are ordered by score at once (2^24 keys are 128 MB), and their strips, at most.
PLACE_BITS = 24
ORDERED_STRIPS = 256
QUANTIZED_LEVELS = 255
#: Query vectors that are broadcast, at most.
MOST_SENT = 1 << 14


def check_k(k: int) -> int:
    if not 1 <= k <= MOST_K:
        raise ValueError(f"k must be 1 to {MOST_K}, not {k}")
    return k


def top_k(scored: DataFrame, k: int, by: str | list[str] = "qid", score: str = "score", tie: str = "id", largest: bool = True) -> DataFrame:
    """The k best rows of each query with their rank. Spark cuts each partition to k rows before the shuffle."""
    order = F.col(score).desc_nulls_last() if largest else F.col(score).asc_nulls_last()
    ranks = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order, F.col(tie).asc())
    return scored.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= check_k(k))


def _widths(vectors: pa.Array) -> int:
    """The one width of the vectors of a batch; vectors of several widths are an error."""
    found = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(found) > 1:
        raise ValueError(f"vectors of {sorted(found)} components in one column")
    return found[0]


def _matrix_rows(id_name: str, rows: int, keys: list[str]):
    """(id, keys.., group, vector), sorted by the keys -> one row per block of equal keys: ids, keys, groups, a matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = dict(zip(("id", *keys, "group", "vector"), batch.columns, strict=True))
            width = _widths(columns["vector"])
            values = columns["vector"].flatten()
            narrow = values.type == pa.float32()
            flat = np.asarray(values if narrow else values.cast(pa.float64())).reshape(batch.num_rows, width)
            cuts = np.zeros(batch.num_rows + 1, bool)
            cuts[[0, -1]] = True
            for key in keys:
                cuts[1:-1] |= np.diff(columns[key].to_numpy(zero_copy_only=False)) != 0
            ends = np.flatnonzero(cuts)
            for start, stop in zip(ends[:-1], ends[1:], strict=True):
                for low in range(start, stop, rows):
                    n = min(rows, stop - low)
                    yield pa.RecordBatch.from_pydict(
                        {
                            id_name: pa.array([columns["id"].slice(low, n).to_pylist()], pa.list_(pa.int64())),
                            **{key: columns[key].slice(low, 1) for key in keys},
                            "groups": pa.array([columns["group"].slice(low, n).to_pylist()], pa.list_(pa.string())),
                            "width": pa.array([width], pa.int64()),
                            "matrix": pa.array([flat[low : low + n].astype("<f4" if narrow else "<f8").tobytes()], pa.binary()),
                        }
                    )

    return run


def _blocks(rows: DataFrame, id_name: str, size: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """rows (id, keys.., group, vector) as matrices; rows without a vector are left out."""
    shape = f"{id_name} array<long>, {''.join(f'{k} long, ' for k in keys)}groups array<string>, width long, matrix binary"
    return rows.where("vector is not null").mapInArrow(_matrix_rows(id_name, size, keys), shape)


def _matrix(data: bytes, rows: int, width: int) -> np.ndarray:
    """The doubles of a block, stored as 32-bit numbers where its column had those."""
    kind = "<f4" if len(data) == 4 * rows * width else "<f8"
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches of blocks, of which one at a time is made Python's."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if row["width"] != row["q_width"]:
                raise ValueError(f"query vectors have {row['q_width']} components, documents {row['width']}")
            yield row


def _sized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors with their lengths and squared lengths."""
    return x, np.linalg.norm(x, axis=1), (x * x).sum(axis=1)


def _strips(batches: Iterator[pa.RecordBatch], strip: int):
    """Rows of blocks -> ids, query ids, groups, the vectors of `strip` queries at a time and those of the documents, both sized."""
    for row in _each(batches):
        ids, qids = np.array(row["ids"]), np.array(row["qids"])
        x = _sized(_matrix(row["matrix"], len(ids), row["width"]))
        every = _matrix(row["q_matrix"], len(qids), row["width"])
        for low in range(0, len(qids), strip):
            yield ids, qids[low : low + strip], row["groups"], _sized(every[low : low + strip]), x


def _scores(metric: str, product: np.ndarray, q: list[np.ndarray], x: list[np.ndarray]) -> np.ndarray:
    """Inner products -> scores, from lengths and squared lengths of both sides that broadcast to the products."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            product /= q[0] * x[0]
    return q[1] + x[1] - 2 * product if metric == "l2" else product


def _all_products(metric: str, q: tuple, x: tuple) -> np.ndarray:
    """The matrix of scores (queries x documents)."""
    return _scores(metric, q[0] @ x[0].T, [s[:, None] for s in q[1:]], [s[None] for s in x[1:]])


def _pair_scores(metric: str, q: tuple, x: tuple, at: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Scores of the pairs (query at, document best), each summed in the same order wherever its rows stand: a product of
    matrices rounds by the shape of the block, and so tells copies in different blocks apart."""
    some = max(1, (1 << 17) // max(1, q[0].shape[1]))
    product = [np.einsum("ij,ij->i", q[0][at[i : i + some]], x[0][best[i : i + some]]) for i in range(0, len(at), some)]
    return _scores(metric, np.concatenate(product), [s[at] for s in q[1:]], [s[best] for s in x[1:]])


def _rounding(metric: str, q: tuple, x: tuple) -> np.ndarray:
    """For each query, twice what a score of the matrix and that of its pair may differ by at most, with room."""
    unit, most = (q[0].shape[1] + 8) * 2.0**-50, np.fmax.reduce(x[1])
    with np.errstate(invalid="ignore", over="ignore"):
        return np.full(len(q[1]), unit) if metric == "cosine" else unit * (q[1] + most) ** 2 if metric == "l2" else unit * q[1] * most


def _block_scores(metric: str, strip: int = QUERY_BLOCK):
    """Rows of blocks -> ids, query ids, groups and the matrix of scores (queries x documents), for `strip` queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        for ids, qids, groups, q, x in _strips(batches, strip):
            yield ids, qids, groups, _all_products(metric, q, x)

    return run


def _score_blocks(metric: str, k: int):
    """A block of documents and one of queries -> per query and group its k best documents, by score and then id, never more:
    of documents that tie, such as copies, others than the first could not be among the k best of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, qids, groups, q, x in _strips(batches, STRIP):
            names, group = np.unique(np.array(groups, dtype=object).astype(str), return_inverse=True)
            by_id = np.array([np.iinfo(np.int64).min if i is None else i for i in ids]) if ids.dtype == object else ids
            score, off = _all_products(metric, q, x), _rounding(metric, q, x)[:, None]
            for g, name in enumerate(names):
                own = np.flatnonzero(group == g)
                key = score[:, own] if metric == "l2" else -score[:, own]
                n = min(k, len(own))
                with np.errstate(invalid="ignore"):
                    last = np.partition(key, n - 1, axis=1)[:, n - 1 : n] + off
                at, best = np.nonzero((key <= last) | np.isnan(last))
                best = own[best]
                found = _pair_scores(metric, q, x, at, best)
                order = np.lexsort((by_id[best], found if metric == "l2" else -found, at))
                order = order[np.arange(len(at)) - np.searchsorted(at, at) < n]
                at, best, found = at[order], best[order], found[order]
                columns = [pa.array(qids[at], pa.int64()), pa.array(ids[best], pa.int64()), pa.array([str(name)] * len(at), pa.string()), pa.array(found, from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "id", "grp", "score"])

    return run


def _all_scores(metric: str, least: float | None):
    """A block of documents and one of queries -> every pair, or those of at least a score (at most a distance)."""
    scores = _block_scores(metric, STRIP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, qids, _, score in scores(batches):
            for low in range(0, len(qids), 16):
                part = score[low : low + 16]
                good = np.ones(part.shape, bool) if least is None else part <= least if metric == "l2" else part >= least
                at, best = np.nonzero(good)
                columns = [pa.array(qids[low + at]), pa.array(ids[best]), pa.array(part[at, best], from_pandas=True)]
                yield pa.RecordBatch.from_arrays(columns, ["qid", "id", "score"])

    return run


def _pairs(qids: np.ndarray, ids: np.ndarray, scores: np.ndarray, rounded: bool) -> pa.RecordBatch:
    columns = [pa.array(qids, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, from_pandas=True), pa.array(np.full(len(ids), rounded))]
    return pa.RecordBatch.from_arrays(columns, ["qid", "id", "score", "rounded"])


def _ordered(keys: np.ndarray, strips: list[tuple[int, np.ndarray, np.ndarray]], digits: int) -> Iterator[pa.RecordBatch]:
    """Keys (a score in units of its last digit, then the place of its pair in strips) -> the pairs, by score where the bulk
    of the scores are so near each other that many are equal, else as they are."""
    some = np.sort(keys[:: max(1, len(keys) // DOC_BLOCK)] >> PLACE_BITS)
    if some[len(some) * 19 // 20] - some[len(some) // 20] < len(keys) // 2:
        keys.sort()
    starts, qids, ids = zip(*strips, strict=True)
    starts, wide = np.array(starts), np.array([len(i) for i in ids])
    first_q, first = (np.cumsum([0, *map(len, side[:-1])]) for side in (qids, ids))
    qids, ids = np.concatenate(qids), np.concatenate(ids)
    for low in range(0, len(keys), 1 << 16):
        key = keys[low : low + (1 << 16)]
        place = key & ((1 << PLACE_BITS) - 1)
        strip = np.searchsorted(starts, place, side="right") - 1
        at, best = np.divmod(place - starts[strip], wide[strip])
        yield _pairs(qids[first_q[strip] + at], ids[first[strip] + best], (key >> PLACE_BITS) / 10.0**digits, True)


def _alike_scores(metric: str, digits: int):
    """Blocks of documents and of queries -> every pair. Pairs whose scores round to one number have that number and stand side
    by side, so that a file stores it once and not 8 bytes a pair. Scores next to the middle of two numbers, very large ones
    and those that are no numbers leave as they are, for Spark to round."""
    scores, unit = _block_scores(metric, STRIP), 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.empty(1 << PLACE_BITS, np.int64)
        strips, used, n = [], 0, 0
        for ids, qids, _, score in scores(batches):
            if used + score.size > len(keys) or len(strips) == ORDERED_STRIPS:
                if n:
                    yield from _ordered(keys[:n], strips, digits)
                strips, used, n = [], 0, 0
            with np.errstate(invalid="ignore", over="ignore"):
                units = score.ravel() * unit
                whole = np.rint(units)
                sure = (np.abs(whole) < 2.0 ** (62 - PLACE_BITS)) & (np.abs(np.abs(units - whole) - 0.5) > np.abs(units) * 2.0**-50)
            good = np.flatnonzero(sure)
            keys[n : n + len(good)] = (whole[good].astype(np.int64) << PLACE_BITS) + (used + good)
            strips.append((used, qids, ids))
            used, n = used + score.size, n + len(good)
            others = np.flatnonzero(~sure)
            for low in range(0, len(others), 1 << 16):
                at, best = np.divmod(others[low : low + (1 << 16)], len(ids))
                yield _pairs(qids[at], ids[best], score[at, best], False)
        if n:
            yield from _ordered(keys[:n], strips, digits)

    return run


def _query_blocks(queries: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Blocks of the queries (qid, keys.., vector), the side of a search that is sent around if it is small enough."""
    q = _blocks(queries.select("qid", *keys, F.lit("").alias("grp"), "vector"), "qids", QUERY_BLOCK, keys)
    return q.select("qids", *keys, F.col("width").alias("q_width"), F.col("matrix").alias("q_matrix"))


def _dealt(blocks: DataFrame, least: int = 1) -> DataFrame:
    """Blocks, stored and dealt evenly: about TASK_BLOCKS a task, fewer where that would be under `least` tasks. A table of one
    row group is read, and its blocks are made, by one task."""
    made = stored(blocks)
    n = made.count()
    return made.repartition(max(1, min(n, max(least, -(-n // TASK_BLOCKS)))))


def _pairs_of_blocks(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block of documents with every block of queries. Blocks are made once and stored, so a task that scores them holds
    one Python worker and makes no block again for each partition of the other side; neither side is broadcast. What a task
    scores and sorts depends neither on the size of the tables nor on the files that hold them."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return _dealt(docs, cores).hint("shuffle_replicate_nl").crossJoin(_dealt(queries))


def knn_exact(docs: DataFrame, queries: DataFrame, k: int = 10, metric: str = "ip", group: str | None = None) -> DataFrame:
    """qid, id, score, rank: the k nearest documents (id, vector) of each query (qid, vector); with `group` (a column of
    docs), of each query and group, and the column grp.

    Both sides are packed into matrices; every block of queries meets every block of documents once and leaves at most k
    rows per query (and ties) for the top-k. Documents and queries with a null vector are left out; a vector of another
    width than the others is an error.
    """
    own = F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp") if group else F.lit("").alias("grp")
    d = _blocks(docs.select("id", own, "vector"), "ids", DOC_BLOCK)
    best = _score_blocks(metric, check_k(k))
    scored = _pairs_of_blocks(d, _query_blocks(queries)).mapInArrow(best, "qid long, id long, grp string, score double")
    largest = V.METRICS[metric][1]
    return top_k(scored, k, by=["qid", "grp"], largest=largest) if group else top_k(scored.drop("grp"), k, largest=largest)


def score_pairs(docs: DataFrame, queries: DataFrame, metric: str = "ip", least: float | None = None, digits: int | None = None) -> DataFrame:
    """qid, id, score of every query (a stated set) and document, block by block; with `least`, of the pairs that reach it
    (l2: that are as near), which is all that leaves a block. With `digits`, of all pairs, rounded to so many digits and ordered
    by score within blocks, so that the result, which grows with the square, takes about half the bytes where it is written."""
    if least is not None and digits is not None:
        raise ValueError("least and digits are not given together")
    d = _blocks(docs.select("id", F.lit("").alias("grp"), "vector"), "ids", DOC_BLOCK)
    pairs = _pairs_of_blocks(d, _query_blocks(queries))
    if digits is None:
        return pairs.mapInArrow(_all_scores(metric, least), "qid long, id long, score double")
    scored = pairs.mapInArrow(_alike_scores(metric, digits), "qid long, id long, score double, rounded boolean")
    return scored.select("qid", "id", F.when(F.col("rounded"), F.col("score")).otherwise(F.round("score", digits)).alias("score"))


def assign_cells(vectors: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """vectors with the numbers of their `probes` nearest centres, nearest first (column cells)."""

    @F.pandas_udf("array<int>")
    def nearest(v):
        x = np.stack(v.to_numpy()).astype(float)
        far = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T
        import pandas as pd

        return pd.Series(list(np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return vectors.withColumn("cells", nearest("vector"))


def train_cells(docs: DataFrame, cells: int, seed: int = 7, most_rows: int = 100_000) -> np.ndarray:
    """Centres of a k-means clustering, fitted on at most about most_rows rows chosen by a hash of the id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    docs = docs.where("vector is not null")
    share = min(1.0, most_rows / max(1, docs.count()))
    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    fit = KMeans(k=cells, seed=seed, featuresCol="v", maxIter=10).fit(sample.select(array_to_vector("vector").alias("v")))
    return np.array(fit.clusterCenters())


def build_ivf(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index: every document with a vector in a block of its cell. Cells are dealt by ranges of cell and a hash of the
    id, so a large cell is several tasks. Write it, to search it more than once."""
    placed = assign_cells(docs.where("vector is not null").select("id", "vector"), centres, 1)
    placed = placed.select("id", F.col("cells")[0].cast("long").alias("cell"), F.lit("").alias("grp"), "vector")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = placed.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell")
    return _blocks(ranges, "ids", DOC_BLOCK, ["cell"])


def search_ivf(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 4, metric: str = "ip") -> DataFrame:
    """qid, id, score, rank from an index: each query meets the blocks of its `probes` nearest cells, scored exactly."""
    q = assign_cells(queries.where("vector is not null").select("qid", "vector"), centres, min(probes, len(centres)))
    q = q.select("qid", F.explode(F.col("cells").cast("array<long>")).alias("cell"), "vector").repartition("cell").sortWithinPartitions("cell")
    near = index.join(_query_blocks(q, ["cell"]), "cell").drop("cell")
    scored = near.mapInArrow(_score_blocks(metric, check_k(k)), "qid long, id long, grp string, score double")
    return top_k(scored.drop("grp"), k, largest=V.METRICS[metric][1])


def knn_ivf(docs: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 10, probes: int = 4, metric: str = "ip") -> DataFrame:
    """Approximate k nearest: only documents in a query's `probes` nearest cells are scored, exactly.

    Every document is indexed. With as many probes as cells the result is that of knn_exact. Blocks of documents and of
    queries meet by an equi-join on the cell.
    """
    return search_ivf(build_ivf(docs, centres), queries, centres, k, probes, metric)


def quantize_sq8(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """8-bit codes of vectors (column codes, array<int> 0..255), and per place its lowest and highest value."""
    places = stored(vectors.select(F.posexplode("vector").alias("place", "x")).groupBy("place").agg(F.min("x").alias("low"), F.max("x").alias("high")))
    bounds = places.agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("bounds"))
    code = F.zip_with(
        "vector",
        "bounds",
        lambda x, b: F.when(b["high"] > b["low"], F.round((x - b["low"]).cast("double") / (b["high"] - b["low"]).cast("double") * QUANTIZED_LEVELS)).otherwise(0.0).cast("int"),
    )
    return vectors.crossJoin(F.broadcast(bounds)).withColumn("codes", code).drop("bounds"), places


def _coded_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector, codes) -> one row per block of rows: ids, width, a matrix of the vectors, their codes as bytes."""
    for batch in batches:
        for low in range(0, batch.num_rows, DOC_BLOCK):
            ids, vectors, codes = batch.slice(low, DOC_BLOCK).columns
            width = _widths(vectors)
            narrow = vectors.flatten().type == pa.float32()
            made = {"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "width": pa.array([width], pa.int64())}
            made["matrix"] = pa.array([np.asarray(vectors.flatten().cast(pa.float32() if narrow else pa.float64())).tobytes()], pa.binary())
            made["codes"] = pa.array([np.asarray(codes.flatten()).astype(np.uint8).tobytes()], pa.binary())
            yield pa.RecordBatch.from_pydict(made)


def _rescored(low: np.ndarray, high: np.ndarray, k: int):
    """A block of codes and one of queries -> exact scores of all rows of the block that may be among its k best."""
    step, reach = (high - low) / QUANTIZED_LEVELS, np.maximum(np.abs(low), np.abs(high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            ids, qids, width = np.array(row["ids"]), np.array(row["qids"]), row["width"]
            x = _matrix(row["matrix"], len(ids), width)
            every = _matrix(row["q_matrix"], len(qids), width)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), width).T.astype(np.float32)
            n = min(k, len(ids)) - 1
            for begin in range(0, len(qids), STRIP):
                q = every[begin : begin + STRIP]
                with np.errstate(invalid="ignore", over="ignore"):
                    scaled = q * step
                    rough = (scaled.astype(np.float32) @ codes) + (q @ low)[:, None]
                    off = np.abs(scaled).sum(axis=1) * (0.5 + 1e-3) + np.abs(q) @ reach * (width + 8) * 2.0**-20
                    rough[~np.isfinite(rough)] = np.nan
                    lowest = np.where(np.isnan(rough), -np.inf, rough - off[:, None])
                    least = -np.partition(-lowest, n, axis=1)[:, n : n + 1]
                    at, best = np.nonzero(~(rough + off[:, None] < least))
                for some in range(0, len(at), 8 * DOC_BLOCK):
                    a, b = at[some : some + 8 * DOC_BLOCK], best[some : some + 8 * DOC_BLOCK]
                    score = np.einsum("ij,ij->i", q[a], x[b])
                    yield pa.RecordBatch.from_arrays([pa.array(qids[begin + a]), pa.array(ids[b]), pa.array(score, from_pandas=True)], ["qid", "id", "score"])

    return run


def knn_sq8(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, score, rank: the k nearest documents by inner product, found by 8-bit codes and exact.

    A quantized score is off by at most half a step per place times |query component|, summed (`off`, with room for the
    rounding of floats). So every row of a block whose quantized score plus `off` reaches the k-th best quantized score of the
    block minus `off` may be among the k best: all of them are scored exactly, where they are read, however many they are.
    Codes and queries meet as matrices, each block once. The lowest and highest value of each place reach the driver.
    """
    coded, places = quantize_sq8(docs.select("id", "vector").where("vector is not null"))
    bounds = sorted(places.select("place", F.col("low").cast("double"), F.col("high").cast("double")).collect())
    low, high = (np.array([b[c] for b in bounds], float) for c in ("low", "high"))
    blocks = coded.select("id", "vector", "codes").mapInArrow(_coded_blocks, "ids array<long>, width long, matrix binary, codes binary")
    q = stored(_query_blocks(queries))
    sent = q.agg(F.coalesce(F.sum(F.size("qids")), F.lit(0))).first()[0] <= MOST_SENT
    near = stored(blocks).crossJoin(F.broadcast(q) if sent else q)
    return top_k(near.mapInArrow(_rescored(low, high, check_k(k)), "qid long, id long, score double"), k)


def rank_scores(hits: DataFrame, k: int | None = None, dedup: bool = True, largest: bool = True, keep: str = "id") -> DataFrame:
    """Hits by score (nulls last), one per id if dedup, at most k, with their place."""
    order = [F.col("score").desc_nulls_last() if largest else F.col("score").asc_nulls_last(), F.col(keep).asc()]
    if dedup:
        best = Window.partitionBy(keep).orderBy(*order)
        hits = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return hits.orderBy(*order).limit(check_k(k)) if k is not None else hits.orderBy(*order)


def fuse_max(hits: DataFrame, k: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Hits of several query vectors as one list: the best score of each document."""
    best = hits.groupBy(*by, "id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(check_k(k)) if not by else top_k(best, k, by=by[0])


def group_best(docs: DataFrame, queries: DataFrame, field: str, k: int, metric: str = "ip") -> DataFrame:
    """Grouped search: per query the best document of each value of a field, then the k best of those."""
    best = knn_exact(docs, queries, 1, metric, group=field).drop("rank").withColumnRenamed("grp", field)
    return top_k(best, k, largest=V.METRICS[metric][1])


def page(hits: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of ordered hits."""
    return hits.orderBy(*order).offset((number - 1) * size).limit(size)


def project_payload(hits: DataFrame, keys: list[str] | None, meta: str = "metadata") -> DataFrame:
    """Keep the named metadata keys of each hit: None keeps all, [] none; a key that a hit lacks is an error."""
    if keys is None:
        return hits
    if keys:
        lacking = hits.where(~F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(F.col(meta), k)))
        if lacking.limit(1).count():
            raise ValueError(f"some hits lack a key of {keys}")
    wanted = F.array(*map(F.lit, keys)) if keys else F.array().cast("array<string>")
    return hits.withColumn(meta, F.map_filter(meta, lambda k, v: F.array_contains(wanted, k)))


def envelope(hits: DataFrame, collection: Column) -> DataFrame:
    """Hits as returned to callers: collection_id, id, score, content, mime_type, metadata without its mime_type."""
    return hits.select(
        collection.alias("collection_id"),
        "id",
        "score",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(F.col("metadata")["mime_type"], F.lit("text/plain")).alias("mime_type"),
        F.map_filter("metadata", lambda k, v: k != "mime_type").alias("metadata"),
    )


def strip_content(rows: DataFrame, content: str, vector: str, passed: Column | None = None) -> DataFrame:
    """rows whose content is null where they have a vector, and whose vector is null where a classifier has let them pass."""
    has = F.col(vector).isNotNull()
    kept = F.when(~F.coalesce(passed, F.lit(False)), F.col(vector)) if passed is not None else F.col(vector)
    return rows.withColumns({content: F.when(~has, F.col(content)), vector: kept})


def search_collections(docs: DataFrame, queries: DataFrame, k: int, rerank: bool = True, metric: str = "ip", registry: DataFrame | None = None) -> DataFrame:
    """qid, collection_id, id, score, rank: the k nearest documents of each query in each collection, in one pass.

    With rerank, `place` numbers a query's hits over all collections by score, nulls last; there is no second limit. Scores
    compare only between collections of one pipeline: with a registry (id, pipeline) others are an error.
    """
    if rerank and registry is not None:
        own = registry.join(docs.select(F.col("collection_id").alias("id")).distinct(), "id", "left_semi")
        if own.select("pipeline").distinct().limit(2).count() > 1:
            raise ValueError("collections of several pipelines cannot be ranked together")
    hits = knn_exact(docs, queries, k, metric, group="collection_id").withColumnRenamed("grp", "collection_id")
    if not rerank:
        return hits
    order = F.col("score").desc_nulls_last() if V.METRICS[metric][1] else F.col("score").asc_nulls_last()
    return hits.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(order, "id")))
