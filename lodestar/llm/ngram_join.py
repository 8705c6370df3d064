"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity over a threshold.

Method: multiple-global-order filtering. If |x & y| >= t |x | y|, then under *every* global order of the shingles the
first |x| - ceil(t |x|) + 1 shingles of x and those of y share one. A pair is a candidate only if it shares prefix
shingles under several orders; only then its whole sets are fetched and intersected.

* Order 1 puts shingles of few documents first (hash breaks ties), so that passages shared by many documents stay out
  of the prefixes. Its prefixes are exploded and joined; a shared shingle must also stand early enough in both.
* A parity sketch of a few bits a shingle then drops pairs that cannot have the overlap.
* The orders 2.. are orders by other hashes within the same two classes. The prefixes of documents that are still in a
  pair are kept as arrays of 32-bit hashes, and pairs that share none under some order go. Equal shingles have equal
  hashes, so this loses no link.
* How common a shingle is only shapes order 1, never the result: any order gives the same links. So a table of the
  FREQUENT most common shingles (a fixed bound: 8 bytes each) is enough; all others count as rare.
* Documents of equal sets form a class with one representative; only representatives are joined.
* Links are needed as far as they connect: round 1 verifies, for each shingle group, links to one centre, so that
  near copies by the thousand become one component without all their pairs. Round 2 then takes every remaining pair of
  different components; when none is left, no link between different components can be missing.

Edge cases: null, empty and blank texts have no shingles, component_id = doc_id and no links. A text of fewer than
`words` words is one shingle. Rows that share a doc_id are judged by their own texts. A null doc_id gives a null
component_id, and its row links with nothing. Other columns of docs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.shared import connected_components, drop_folder, materialize, mix, shared_folder, shingle_sets, small

FREQUENT = 1 << 18
SKETCH_BITS = (256, 1 << 17)
ORDERS = 3
#: Counters of a task's summary of common shingles, and shingles that are counted before they are merged into it.
COUNTERS, BUFFER = 1 << 18, 1 << 19
_TOP = np.uint64(1 << 63)


def _places(tokens: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles are frequent, and their places by rising frequency."""
    if not len(frequent):
        return np.zeros(len(tokens), bool), np.empty(0, np.uint64)
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    common = frequent[at] == tokens
    return common, place[at[common]]


def _order(tokens: np.ndarray, common: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Sort keys of a global order: rare shingles by hash, then frequent ones, by falling rarity if seed is 0."""
    key = (tokens if seed == 0 else mix(tokens + np.uint64(seed))) >> np.uint64(1)
    key[common] = _TOP | (places if seed == 0 else key[common])
    return key


def _prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _lowered(token: np.ndarray, n: np.ndarray, counters: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """At most `counters` of the counts, all lowered by the largest of the others; and by how much."""
    cut = 0
    if len(token) > counters:
        cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
        token, n = token[n > cut], n[n > cut] - cut
    return (token, n), cut


def _summary(tokens: np.ndarray, known: tuple[np.ndarray, np.ndarray], counters: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """A summary (shingles and counts) with more shingles counted, and by how much counts were lowered at most."""
    tokens.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))
    more, cut = _lowered(tokens[first], np.diff(np.append(first, len(tokens))), counters)
    token, n = (np.concatenate(x) for x in zip(known, more, strict=True))
    if not len(token):
        return (token, n), cut
    order = np.argsort(token, kind="stable")
    token, n = token[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    both, again = _lowered(token[first], np.add.reduceat(n, first), counters)
    return both, cut + again


def _count_common(words: int, counters: int, buffer: int):
    """Counts of the shingles that stand twice or more in a task, at most 2 N / counters too low for N shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.empty(0, np.uint64), np.empty(0, np.int64)
        held, size, lowered = [], 0, 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), words):
                held.append(s)
                size += len(s)
                if size >= buffer:
                    tokens, held, size = np.concatenate(held), [], 0
                    known, cut = _summary(tokens, known, counters)
                    lowered += cut
        if held:
            known, cut = _summary(np.concatenate(held), known, counters)
            lowered += cut
        token, n = (x[known[1] + lowered > 1] for x in known)
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    return run


def _describe(words: int, num: int, den: int, frequent: np.ndarray, place: np.ndarray):
    """Rows (doc_id, h, n, k1, k2, cut, sketch, rare, common) of all documents.

    h: a hash of the text; n: set size; k1, k2: two hashes of the set; sketch: parity of the set's hashes by places, a power of two of at least
    8 n / 3 within SKETCH_BITS; rare and common: the prefix under order 1, in order, cut (after `cut` shingles) where the
    frequent ones begin.
    """
    names = ["doc_id", "h", "n", "k1", "k2", "cut", "sketch", "rare", "common"]

    def lists(parts: list) -> pa.Array:
        ends = np.cumsum([0] + [0 if p is None else len(p) for p in parts]).astype(np.int32)
        flat = np.concatenate([p for p in parts if p is not None] or [np.empty(0, np.int64)])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            sets = shingle_sets(batch.column(1), words)
            upcoming = next(sets, None)
            ids = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for row, (doc_id, h) in enumerate(ids):
                if upcoming is None or upcoming[0] != row:
                    made.append((doc_id, h, 0, None, None, None, None, None, None))
                    continue
                s = upcoming[1]
                upcoming = next(sets, None)
                places = min(max(1 << (8 * len(s) // 3).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
                bits = np.bincount((s & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
                keys = _order(s, *_places(s, frequent, place), 0)
                first = np.argsort(keys, kind="stable")[: _prefix_size(len(s), num, den)]
                prefix, cut = s[first], int(np.count_nonzero(keys[first] < _TOP))
                prefix = prefix.view(np.int64)
                made.append(
                    (
                        doc_id,
                        h,
                        len(s),
                        int(np.bitwise_xor.reduce(s).view(np.int64)),
                        int(np.add.reduce(mix(s)).view(np.int64)),
                        cut,
                        np.packbits(bits.astype(np.uint8)).tobytes(),
                        prefix[:cut],
                        prefix[cut:],
                    )
                )
                held += len(prefix)
                if held > 500_000:
                    yield out(made)
                    made, held = [], 0
            if made:
                yield out(made)

    def out(made: list) -> pa.RecordBatch:
        doc_id, h, n, k1, k2, cut, sketch, rare, common = zip(*made, strict=True)
        longs = [pa.array(x, pa.int64()) for x in (doc_id, h, n, k1, k2, cut)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(sketch, pa.binary()), lists(rare), lists(common)], names)

    return run


def _sketches_allow(num: int, den: int):
    """Pairs (a, b, na, nb, sa, sb) whose parity sketches leave room for the overlap that a link needs.

    Each place where the parities differ holds at least one shingle of only one of the two sets. The longer sketch is
    folded to the length of the shorter, which gives the parities for fewer places.
    """

    def apart(x: bytes, y: bytes) -> int:
        short, long_ = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
        folded = np.bitwise_xor.reduce(long_.reshape(-1, len(short)), axis=0)
        return int(np.bitwise_count(folded ^ short).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, sa, sb = batch.columns
            if not len(a):
                continue
            differ = np.array([apart(x, y) for x, y in zip(sa.to_pylist(), sb.to_pylist(), strict=True)])
            total = na.to_numpy() + nb.to_numpy()
            keep = pa.array((total - differ) // 2 >= -(-num * total // (num + den)))
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return run


def _lists(words: int, make, names: list[str], kind: pa.DataType):
    """Rows (key, text) -> key and the lists that make(set of shingles) gives, for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, held = [], 0
            for row, s in shingle_sets(batch.column(1), words):
                made.append((batch.column(0)[row].as_py(), *make(s)))
                held += len(s)
                if held > 500_000:
                    yield out(made)
                    made, held = [], 0
            if made:
                yield out(made)

    def out(made: list) -> pa.RecordBatch:
        key, *lists = zip(*made, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(x, pa.list_(kind)) for x in lists)], ["key", *names])

    return run


def frequent_shingles(docs: DataFrame, words: int, most: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (sorted) of at most `most` common shingles and each one's place by rising frequency.

    Each task counts all its shingles in a summary of COUNTERS counters, so no shingle of more than 2 N / COUNTERS of all N
    occurrences is missed, however they are spread, but for one occurrence a task; whole levels of frequency are taken
    from the top.
    """
    counted = docs.select("text").mapInArrow(_count_common(words, COUNTERS, BUFFER), "token long, n long")
    counts = materialize(counted.groupBy("token").agg(F.sum("n").alias("n")), folder, "common")
    levels = counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).limit(most).collect()
    least, taken = 1 << 62, 0
    for level in levels:
        taken += level.c
        if taken > most:
            break
        least = level.n
    by_rarity = counts.where(F.col("n") >= least).orderBy("n", "token").toPandas().token.to_numpy(np.int64).view(np.uint64)
    sort = np.argsort(by_rarity)
    return by_rarity[sort], sort.astype(np.uint64)


def near_duplicate_components(
    docs: DataFrame, words: int = 5, threshold: str = "0.75", frequent_most: int = FREQUENT, orders: int = ORDERS, text_hash: bool = False
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id reachable by links;
    with text_hash also xxhash64(text), by which rows of one doc_id are told apart, and `first`: whether the row, or one of
    equal doc_id and text, represents its component (a row without doc_id does so itself).

    threshold is a decimal or a ratio in text, so that the test is exact in integers. At most `frequent_most` hashes
    are sent to the executors, whatever the size of docs.
    """
    spark = docs.sparkSession
    share = Fraction(threshold)
    num, den = share.numerator, share.denominator
    folder = shared_folder(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    frequent, place = frequent_shingles(docs, words, frequent_most, folder)

    shape = "doc_id long, h long, n long, k1 long, k2 long, cut long, sketch binary, rare array<long>, common array<long>"
    described = materialize(docs.mapInArrow(_describe(words, num, den, frequent, place), shape), folder, "described")

    # A row's key is its doc_id, or, where rows of one doc_id differ in text, a hash of both.
    several = described.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = materialize(several.where("low <> high").select("doc_id", F.lit(True).alias("several")), folder, "several")

    def keyed(df: DataFrame) -> DataFrame:
        key = F.when(F.col("several"), F.xxhash64("doc_id", "h")).otherwise(F.col("doc_id"))
        return df.join(several, "doc_id", "left").withColumn("key", key).drop("several")

    own = keyed(described).where("doc_id is not null and n > 0")
    least = (F.min("key").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    classes = own.groupBy("k1", "k2", "n").agg(*least)
    copies = materialize(classes.where("copies > 1").drop("copies"), folder, "copies")
    others = own.select("key", "k1", "k2", "n").join(copies, ["k1", "k2", "n"]).where("rep <> key").select("key").distinct()
    reps = own.join(small(materialize(others, folder, "others")), "key", "left_anti")

    # Prefix shingles that two representatives share. Rare ones have small groups and need one shuffle; the frequent
    # ones are at most frequent_most and are counted first, then looked up without a shuffle.
    def exploded(which: str) -> DataFrame:
        first = F.lit(0) if which == "rare" else F.col("cut").cast("int")
        return reps.select("key", F.col("n").cast("int").alias("n"), F.posexplode(which).alias("pos", "token"), first.alias("first")).select(
            "token", "key", "n", (F.col("pos") + F.col("first")).alias("pos")
        )

    group = Window.partitionBy("token")
    lowest = F.min(F.struct("key", "n", "pos"))
    rare = exploded("rare").withColumn("df", F.count("*").over(group)).where("df > 1")
    rare = rare.withColumn("centre", lowest.over(group)).drop("df")
    common = exploded("common")
    shared = common.groupBy("token").agg(F.count("*").alias("df"), lowest.alias("centre")).where("df > 1").drop("df")
    groups = materialize(rare.unionByName(common.join(F.broadcast(shared), "token")), folder, "groups")
    sketches = own.select("key", "n", "sketch").dropDuplicates(["key"])

    def sizes(x: str, y: str) -> str:
        """Whether sets of n elements may be alike by their sizes."""
        return f"{den} * {x}n >= {num} * {y}n and {den} * {y}n >= {num} * {x}n"

    def close(x: str, y: str) -> str:
        """Whether two sets may be alike whose first common shingle stands at pos in each."""
        need = f"({num} * cast({x}n + {y}n as long) + {num + den - 1}) div {num + den}"
        return f"{sizes(x, y)} and least({x}n - {x}pos, {y}n - {y}pos) >= {need}"

    def prefix_hashes(s: np.ndarray) -> list[np.ndarray]:
        """32 bits of the hashes of a set's prefixes under the orders from 2."""
        known, size = _places(s, frequent, place), _prefix_size(len(s), num, den)
        firsts = (np.argpartition(_order(s, *known, seed), size - 1)[:size] for seed in range(1, orders))
        return [s[first].astype(np.uint32).view(np.int32) for first in firsts]

    def listed(pairs: DataFrame, name: str, make, names: list[str], kind: pa.DataType, type_: str) -> DataFrame:
        """Lists of the documents in pairs, one row per key: both sides of a join read the same exchange of them."""
        ids = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        texts = keyed(docs).select("key", "text").join(small(materialize(ids, folder, name)), "key", "left_semi")
        shape = ", ".join(["key long", *(f"{n} array<{type_}>" for n in names)])
        return texts.mapInArrow(_lists(words, make, names, kind), shape).dropDuplicates(["key"])

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left, right = (sketches.toDF(x, f"n{x}", f"s{x}") for x in "ab")
        near = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")
        near = materialize(near.mapInArrow(_sketches_allow(num, den), "a long, b long"), folder, f"near-{name}")
        places = [f"o{k}" for k in range(1, orders)]
        if places:
            prefixes = listed(near, f"places-{name}", prefix_hashes, places, pa.int32(), "int")
            left, right = (prefixes.toDF(x, *(f"{o}_{x}" for o in places)) for x in "ab")
            alike = " and ".join(f"arrays_overlap({o}_a, {o}_b)" for o in places)
            near = materialize(near.join(left, "a").join(right, "b").where(alike).select("a", "b"), folder, f"alike-{name}")
        whole = listed(near, f"whole-{name}", lambda s: [s.view(np.int64)], ["tokens"], pa.int64(), "long")
        left, right = (whole.toDF(x, f"t{x}") for x in "ab")
        both = near.join(left, "a").join(right, "b").select("a", "b", F.size("ta").alias("na"), F.size("tb").alias("nb"), F.size(F.array_intersect("ta", "tb")).alias("both"))
        return materialize(both.where(f"{den + num} * cast(both as long) >= {num} * cast(na + nb as long)").select("a", "b"), folder, f"links-{name}")

    stars = groups.where("key <> centre.key").where(sizes("", "centre."))
    links = verified(stars.select(F.col("centre.key").alias("a"), F.col("key").alias("b")).distinct(), "1")
    found = materialize(connected_components(links, f"{folder}/first"), folder, "components-1")

    # What is left: pairs of different components. In a group, one side is outside the group's main component.
    label = F.coalesce("component", "key").alias("comp")
    named = groups.join(found, groups.key == found.node, "left").select("token", "key", "n", "pos", label)
    spread = named.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token")
    spread = spread.agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    mixed = materialize(named.join(spread.select("token", "main"), "token"), folder, "mixed")
    x = mixed.where("comp <> main").select("token", *(F.col(c).alias(f"x{c}") for c in ("key", "n", "pos", "comp")))
    apart = f"xcomp <> comp and (comp = main or xkey < key) and {close('x', '')}"
    rest = x.join(mixed, "token").where(apart).select(F.least("xkey", "key").alias("a"), F.greatest("xkey", "key").alias("b"))
    more = verified(rest.distinct(), "2")
    if more.limit(1).count():
        every = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        found = connected_components(every, f"{folder}/second")

    out = keyed(described.select("doc_id", "h", "n", "k1", "k2")).join(copies, ["k1", "k2", "n"], "left")
    out = out.withColumn("rep", F.coalesce("rep", "key")).join(found, F.col("rep") == F.col("node"), "left")
    out = out.withColumn("component", F.coalesce("component", "rep"))
    # A component is known by its smallest key, which is that of the smallest doc_id but where rows share a doc_id.
    firsts = out.where("doc_id is not null").groupBy("component").agg(F.min(F.coalesce("first_id", "doc_id")).alias("smallest"), F.min(F.struct("doc_id", "h")).alias("first"))
    out = out.join(firsts, "component", "left")
    kept = F.col("doc_id").isNull() | (F.struct("doc_id", "h") == F.col("first"))
    more = [F.col("h").alias("text_hash"), kept.alias("first")] if text_hash else []
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("smallest")).alias("component_id"), *more)
    out = materialize(out, folder, "result")
    parts = [f"{part}-{k}" for part in ("near", "places", "alike", "whole") for k in (1, 2)]
    for part in ("common", "groups", "mixed", "described", "several", "copies", "others", "first", "second", *parts):
        drop_folder(spark, f"{folder}/{part}")
    return out
