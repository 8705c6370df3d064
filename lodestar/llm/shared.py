"""Tables written between steps, links to components, and words of Arrow batches as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_base


def shared_folder(spark: SparkSession) -> str:
    """A new folder for steps below spark.checkpoint.dir, which driver and executors share; an error on a cluster without it."""
    return shared_base(spark, "steps")


def materialize(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name_2, name_3, .. if df has a column of that name already (capital letters don't matter)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(2, len(taken) + 3))) if n.lower() not in taken)


def small(df: DataFrame, most: int = 1 << 19) -> DataFrame:
    """df, a written table of narrow rows, marked for a broadcast join if it has at most `most` rows: about 16 MB."""
    return F.broadcast(df) if df.count() <= most else df


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of steps through Hadoop's file system, whatever the store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Links of one node that a task takes at once.
HOT = 10_000


def connected_components(edges: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links a-b; component is the smallest node reachable.

    Alternates large-star and small-star steps: each is one shuffle by node that keeps, for a node and its
    neighbours, links to the smallest of them. Every round is written to the shared folder. The smallest neighbour is
    found by min() before the shuffle, and it is brought to the links of a node of very many in parts of HOT links: the
    nodes that need this are at most 2 links / HOT rows, which are sent to all tasks.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        if large:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.expr(f"count(*) div {HOT}").alias("parts"))
        hot = F.broadcast(low.where("parts > 0").select("u", F.col("parts").alias("last")))
        part = F.pmod(F.xxhash64("v"), F.coalesce("last", F.lit(0)) + 1)
        dealt = both.join(hot, "u", "left").select("u", "v", part.alias("part"))
        parts = low.select("u", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))).alias("part"))
        linked = dealt.join(parts, ["u", "part"])
        if large:
            moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return moved.where("u <> v").distinct()

    def is_forest(links: DataFrame) -> bool:
        """Whether every link ends at the root of a star: no u has two links, and none is a v."""
        ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        sums = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return sums.where("up > 1 or (up = 1 and down = 1)").limit(1).count() == 0

    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, step = materialize(links, folder, "cc-0"), 0
    while not is_forest(links):
        step += 1
        links = materialize(star(star(links, True), False), folder, f"cc-{step}")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


# --- words of a whole Arrow batch -------------------------------------------------------------------------------

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the offsets of its rows (nulls: no bytes)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased if `lower`, and the number of words of each row."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    firsts = offsets[:-1]
    firsts = firsts[(offsets[1:] > firsts)]
    start[firsts] = word[firsts]
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    stop = word.copy()
    stop[:-1] &= ~word[1:] | start[1:]
    length = np.flatnonzero(stop) + 1 - begin
    letters = _BYTE[_LOWER[data[word]] if lower else data[word]]
    at = np.cumsum(length) - length
    place = np.arange(len(letters)) - np.repeat(at, length)
    power = np.empty(int(length.max()), np.uint64)
    power[0] = 1
    power[1:] = _POWER
    np.multiply.accumulate(power, out=power)
    letters *= power[place]
    words = mix(np.add.reduceat(letters, at) + length.astype(np.uint64) * _GOLD)
    return words, np.diff(np.searchsorted(begin, offsets))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of `size` hashed words, by doubling; empty where there are fewer words."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    whole, have, part, long_, power = np.zeros(len(words) + 1, np.uint64), 0, words, 1, np.full(1, _POWER)
    while True:
        if size & long_:  # the next `long_` words of the window follow the `have` before
            n = len(words) - have - long_ + 1
            whole = whole[:n] * power + part[have : have + n]
            have += long_
        if long_ * 2 > size:
            return mix(whole)
        part = part[:-long_] * power + part[long_:]
        long_, power = long_ * 2, power * power


def slices(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string column, at most about `most` bytes or one row at a time, which bounds arrays of words."""
    column = column.cast(pa.large_string())
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1])
    low = 0
    while low < len(column):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[low : low + 4096]), most, side="right")))
        yield low, column.slice(low, n)
        low += n


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its shingles) of each row that has words.

    A row of fewer words than size has one shingle, the whole sequence. The batch is hashed in slices of about a
    megabyte (or one row), which bounds the arrays.
    """
    for low, rows in slices(column):
        words, counts = word_hashes(*text_bytes(rows))
        ends = np.cumsum(counts)
        if len(words) >= size:
            mixed = np.zeros(len(words) - size + 1, np.uint64)
            for k in range(size):
                mixed *= _POWER
                mixed += words[k : len(words) - size + 1 + k]
            mixed = mix(mixed)
        for row, (end, count) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
            if count >= size:
                yield low + row, np.unique(mixed[end - count : end - size + 1])
            elif count:
                short = np.array([count], np.uint64)
                for w in words[end - count : end]:
                    short = short * _POWER + w
                yield low + row, mix(short * _GOLD)
