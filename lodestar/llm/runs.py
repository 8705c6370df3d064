"""Periodic runs of words: stretches that repeat with a period, and texts without the repeats.

A run is a stretch of consecutive words of smallest period q (words q apart are identical) and at least
max(12, 2 q) words that no neighbouring word extends keeping the period.

Method: descending-LCP Kruskal. The suffixes of a document are sorted by words (prefix doubling over a slice of documents at
once) and neighbours in that order are linked with their longest common prefix (LCP). Links are taken by falling LCP; a
union-find joins the classes of suffixes, each an ordered list of positions, the smaller into the larger. Where two positions
i < j become neighbours in a list while LCP L >= j - i, the words from i on repeat with the period j - i for L + j - i words,
no further to the right. No position of the class lies between them, so the period is the smallest; the run is taken once, at
its first place, where the words before i and j differ.

Three exact cuts keep ordinary text cheap: a run of 12 words or more has two equal 6-grams, so documents without such are done;
LCPs below 6 are no links; and classes whose least gap exceeds their largest LCP have no seeds.

One pass over the partitions without a shuffle; a task holds a slice of about a megabyte of text or one text, with about
60 + 4 log2(longest repeat) bytes a word.

Edge cases: null, empty and blank texts have no words and no runs. A null doc_id is kept (and its text never edited). Rows are
judged each by themselves, so repeated rows give repeated results. Other columns of docs are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import mix, slices, text_bytes, window_hashes, word_hashes

#: Least words of a run; half as many are the least LCP of two of its suffixes a period apart.
LEAST = 12
_SEED = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def suffix_order(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of `words` sorted by document and suffix, and the LCP of each with the one before it (of its document).

    words: hashes; doc: rising numbers of the documents they belong to. Suffixes end with their document.
    """
    n = len(words)
    _, rank = np.unique(words, return_inverse=True)
    order = np.lexsort((rank, doc))
    first = np.ones(n, bool)
    first[1:] = (doc[order[1:]] != doc[order[:-1]]) | (rank[order[1:]] != rank[order[:-1]])
    place = np.flatnonzero(first)[np.cumsum(first) - 1]  # of a class: the place of its first suffix
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = place
    levels, width = [rank], 1
    while True:
        tied = np.flatnonzero(np.append(place[1:] == place[:-1], False) | np.append(False, place[1:] == place[:-1]))
        if not len(tied):
            break
        at = order[tied]
        ahead = np.minimum(at + width, n)
        inside = (ahead < n) & (doc[np.minimum(ahead, n - 1)] == doc[at])
        key = place[tied] * np.int64(n + 1) + np.where(inside, rank[ahead], -1) + 1
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        order[tied] = at[sort]
        first = np.append(True, key[1:] != key[:-1])
        place[tied] = tied[np.flatnonzero(first)[np.cumsum(first) - 1]]
        rank = rank.copy()
        rank[order[tied]] = place[tied]
        levels.append(rank)
        width *= 2
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][left] == levels[k][right]
        step = same.astype(np.int64) << k
        common += step
        left, right = left + step, right + step
    return order, np.append(0, common)


def kruskal_runs(order: np.ndarray, lcp: np.ndarray, words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; starts: whether a position is the first of its document."""
    linked = lcp >= least // 2
    group = np.cumsum(~linked)
    by_place = np.lexsort((order, group))
    place, own = order[by_place], group[by_place]
    gap = np.where(own[1:] == own[:-1], place[1:] - place[:-1], np.iinfo(np.int64).max)
    nearest, longest = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.zeros(group[-1] + 1, np.int64)
    np.minimum.at(nearest, own[1:], gap)
    np.maximum.at(longest, group, np.where(linked, lcp, 0))
    links = np.flatnonzero(linked & (nearest <= longest)[group])
    links = links[np.argsort(-lcp[links], kind="stable")]

    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    runs = []

    def root(x: int) -> int:
        if x not in parent:
            parent[x] = x
            members[x] = [x]
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def seed(i: int, j: int, common: int) -> None:
        if j - i <= common and j - i + common >= least and (starts[i] or words[i - 1] != words[j - 1]):
            runs.append((i, common + j - i, j - i))

    for x, y, common in zip(order[links - 1].tolist(), order[links].tolist(), lcp[links].tolist(), strict=True):
        a, b = root(x), root(y)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        parent[b] = a
        large, small = members[a], members.pop(b)
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at and not (k and large[at - 1] == small[k - 1]):
                seed(large[at - 1], p, common)
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]):
                seed(p, large[at], common)
            large.insert(at, p)
    return runs


def find_runs(words: np.ndarray, counts: np.ndarray, least: int = LEAST) -> dict[int, list[tuple[int, int, int]]]:
    """The runs of each document that has any, by start, then period; words: hashes end to end, counts: words of each."""
    half = least // 2
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = window_hashes(words, half)
    if not len(grams):
        return {}
    inside = np.flatnonzero(doc[: len(grams)] == doc[half - 1 :])
    keys = mix(grams[inside] + doc[inside].astype(np.uint64) * _SEED)
    sort = np.argsort(keys)
    twice = sort[1:][keys[sort[1:]] == keys[sort[:-1]]]
    some = np.zeros(len(counts), bool)
    some[doc[inside[twice]]] = True
    if not some.any():
        return {}
    taken = np.flatnonzero(some[doc])
    words, doc = words[taken], doc[taken]
    starts = np.append(True, doc[1:] != doc[:-1])
    order, lcp = suffix_order(words, doc)
    firsts = dict(zip(doc[starts].tolist(), np.flatnonzero(starts).tolist(), strict=True))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in kruskal_runs(order, lcp, words, starts, least):
        d = int(doc[start])
        found.setdefault(d, []).append((start - firsts[d], length, period))
    return {d: sorted(runs, key=lambda r: (r[0], r[2])) for d, runs in found.items()}


def edit(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) if the n words of this document are to be made periodic from a on with the period p: one id in ten."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: a run's words after its first period go."""
    kept, upto = [], 0
    for start, end in sorted((s + q, s + n) for s, n, q in runs):
        if end > upto:
            kept += words[upto:start]  # empty where start < upto
            upto = end
    return kept + words[upto:]


def _scan(edited: bool, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, rows in slices(batch.column(1)):
                words, counts = word_hashes(*text_bytes(rows), lower=False)
                changes, end = {}, 0
                for k, n in enumerate(counts.tolist() if edited else []):
                    if change := edit(ids[low + k], n):
                        a, p = changes[k] = change
                        own = words[end + a : end + n]
                        own[:] = own[np.arange(n - a) % p]
                    end += n
                found = find_runs(words, counts, least)
                made = []
                for k, text in enumerate(rows.cast(pa.large_binary()).to_pylist()):
                    own = (text or b"").split()  # bytes: white space is ASCII's
                    n = len(own)
                    if k in changes:
                        a, p = changes[k]
                        own = own[:a] + (own[a : a + p] * (-(-(n - a) // p)))[: n - a]
                    runs = found.get(k, [])
                    made.append((ids[low + k], n, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(collapse(own, runs))))
                doc_id, n, runs, texts = zip(*made, strict=True)
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                arrays = [pa.array(doc_id, pa.int64()), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, edited: bool = False, least: int = LEAST) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, runs (by start, then period) and the collapsed text, its words joined by
    one space without those that a run repeats. With `edited`, one text in ten is made periodic first (see edit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(edited, least), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The runs of each document as numbers: their count, the longest, and digests of all of them and of the collapsed text."""
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", ranked).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
