"""Substring deduplication: words in passages of `size` words or more that stand anywhere else go.

A window is `size` consecutive words of one document; each word covered by a window whose words also start anywhere else (in
the same document too) is removed. Method: suffix automata of reference shards. The reference is one occurrence of every
repeated passage, cut into shards of bounded size; the automaton of a shard is built where documents meet it and their
passages are streamed through it for matching statistics, the length of the longest suffix that the shard contains; words
under lengths of `size` or more go.

What keeps this linear, as not every document can meet every shard:

* Each window has an anchor, the 8-gram of smallest hash in it, so equal windows have equal anchors. Anchors are counted over
  all documents, and a bit array of 2^28 bits (32 MB, whatever the input) holds those that stand twice. Windows without such
  an anchor are unique. Where the array fills up, more unique windows pass; nothing is lost.
* Of the windows left, each chunk (about a million words of whole documents) sends its distinct hashes by ranges of hashes. A
  range finds which windows repeat and names their owner: the shard of their first chunk. That goes back to the chunks.
* A chunk cuts its documents' repeated stretches by owner and sends them there, and the stretches it owns as references.
* A shard is at most 100,000 windows. Where many stretches meet one (a passage in a third of all documents), they are dealt
  over several tasks by a salt, and the shard is broadcast to all of these.

Windows are compared by 64-bit hashes when owners are named, and word by word in the automata. Every step is a table in the
shared folder.

Edge cases: null, empty and blank texts have no words. A null doc_id is kept. Rows are documents of their own, so repeated rows
of `size` words lose all. Other columns of docs are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import drop_folder, materialize, shared_folder, slices, small, text_bytes, window_hashes, word_hashes

SIZE, ANCHOR = 35, 8
#: Words of a chunk (of whole documents), windows of a shard, window hashes of a range, words that meet a shard in one task.
CHUNK, SHARD, RANGE, SALT = 1 << 20, 100_000, 1 << 20, 1 << 21
BITS = 28
SCANNED = "chunk long, key long, doc_id long, n_words long, kept_sha256 string, text string, wanted binary, hashes binary, shards binary, many binary"
PARTS = "shard long, reference boolean, key long, start long, words long, text string"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """All substrings of some sequences of words; substrings that cross two of them are kept out by separators."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.last = self.texts = 0

    def add(self, words: Iterable[bytes]) -> None:
        ids = self.ids
        self.texts += 1
        for c in (-self.texts, *(ids.setdefault(w, len(ids)) for w in words)):
            self._extend(c)

    def _extend(self, c: int) -> None:
        follow, link, length = self.next, self.link, self.length
        new, p = len(follow), self.last
        follow.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] != length[p] + 1:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[new] = q
        self.last = new

    def covered(self, words: list[bytes], size: int) -> list[tuple[int, int]]:
        """The maximal stretches (start, end) under matches of `size` words or more."""
        follow, link, length, ids = self.next, self.link, self.length, self.ids
        state, matched, found = 0, 0, []
        for end, w in enumerate(words, 1):
            c = ids.get(w)
            while state and c not in follow[state]:
                state = link[state]
                matched = length[state]
            if c in follow[state]:
                state = follow[state][c]
                matched += 1
            if matched >= size:
                if found and end - matched <= found[-1][1]:
                    found[-1] = (min(found[-1][0], end - matched), end)
                else:
                    found.append((end - matched, end))
        return found


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each `width` neighbours, by doubling."""
    part, long_ = x, 1
    while long_ * 2 <= width:
        part, long_ = best(part[:-long_], part[long_:]), long_ * 2
    rest = width - long_
    return best(part[: len(part) - rest], part[rest:]) if rest else part


def window_anchors(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of windows within a document, the anchor of each, and the anchors at their own places."""
    if len(words) < size:
        return np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 2
    grams = window_hashes(words, ANCHOR)
    width = size - ANCHOR + 1
    least = _sliding(grams, width, np.minimum)
    whole = doc[: len(least)] == doc[size - 1 :]
    padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(least)][whole] = least[whole]
    chosen = (_sliding(padded, width, np.maximum) == grams) & (grams > 0)
    starts = np.flatnonzero(whole)
    return starts, least[starts], grams[chosen]


def _hashed(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, counts = word_hashes(*text_bytes(rows), lower=False)
    return words, counts, np.repeat(np.arange(len(counts)), counts)


def _anchors(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows in slices(batch.column(0)):
                words, _, doc = _hashed(rows)
                anchor, n = np.unique(window_anchors(words, doc, size)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return run


def anchor_bits(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """2^bits bits with two set for each anchor that stands twice or more in docs."""
    counts = docs.select("text").mapInArrow(_anchors(size), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    mask = F.lit((1 << bits) - 1)
    places = F.array(F.col("anchor").bitwiseAND(mask), F.shiftrightunsigned("anchor", 64 - bits).bitwiseAND(mask))
    place = counts.where("n > 1").select(F.explode(places).alias("place"))
    blocks = place.groupBy(F.shiftright("place", 6).alias("block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word"))
    found = blocks.toArrow()  # at most 2^bits / 64 rows
    array = np.zeros(1 << (bits - 6), np.uint64)
    array[found["block"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return array


def _is_set(array: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    """Whether both bits of an anchor are set."""
    out = np.ones(len(anchors), bool)
    for place in (anchors & np.uint64((1 << bits) - 1), anchors >> np.uint64(64 - bits)):
        out &= (array[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _scan(size: int, bits: int, array, chunk_words: int, shard_windows: int):
    """Rows of documents (with their text and wanted windows if they have any, else with their result), and one row per chunk:
    its distinct window hashes in order, and for each the part of its shard and whether it stands twice in the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        chunk, key, held, size_held = task << 24, task << 40, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low, rows in slices(batch.column(1)):
                words, counts, doc = _hashed(rows)
                starts, anchors, _ = window_anchors(words, doc, size)
                wanted = np.zeros(len(words), bool)
                wanted[starts[_is_set(array.value, anchors, bits)]] = True
                hashes = window_hashes(words, size)
                made, end = [], 0
                for k, (n, text) in enumerate(zip(counts.tolist(), rows, strict=True)):
                    own = wanted[end : end + n]
                    text = text.as_py()
                    if own.any():
                        made.append((chunk, key, ids[low + k], n, None, text, np.packbits(own).tobytes()))
                        held.append(hashes[end + np.flatnonzero(own)])
                        size_held += n
                    else:
                        digest = sha256(b" ".join((text or "").encode().split())).hexdigest()
                        made.append((None, key, ids[low + k], n, digest, None, None))
                    key, end = key + 1, end + n
                    if size_held >= chunk_words:
                        yield out(made, held, chunk)
                        chunk, made, held, size_held = chunk + 1, [], [], 0
                if made:
                    yield out(made, [], chunk)
        if held:
            yield out([], held, chunk)

    def out(made: list, held: list, chunk: int) -> pa.RecordBatch:
        made = [(*row, None, None, None) for row in made]
        if held:
            distinct, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
            shards = (first // shard_windows).astype("<u2")
            made.append((chunk, *[None] * 6, distinct.tobytes(), shards.tobytes(), (n > 1).tobytes()))
        schema = pa.schema([(f.split(" ")[0], {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split(" ")[1]]) for f in SCANNED.split(", ")])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return run


def _by_range(ranges: int):
    """The hashes of each chunk by ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        for batch in batches:
            for chunk, hashes, shards, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts = [0, *np.searchsorted(np.frombuffer(hashes, "<u8"), bounds).tolist(), len(many)]
                rows = [(k, chunk, hashes[8 * a : 8 * b], shards[2 * a : 2 * b], many[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                part, chunks, *blobs = zip(*rows, strict=True)
                arrays = [pa.array(part, pa.int64()), pa.array(chunks, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "hashes", "shards", "many"])

    return run


def _owners(table: pa.Table) -> pa.Table:
    """For each chunk of a range: the owner of each of its hashes in order, as a place in `owners`; place 0: not repeated."""
    table = table.sort_by("chunk")
    chunks = table["chunk"].to_numpy()
    hashes, shards, many = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("hashes", "<u8"), ("shards", "<u2"), ("many", bool)))
    sizes = np.array([len(x) for x in table["many"].to_pylist()])
    owner = np.repeat(chunks, sizes) << 12 | shards
    order = np.argsort(hashes, kind="stable")
    same = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
    firsts = np.flatnonzero(~same)
    repeated = (np.diff(np.append(firsts, len(order))) > 1) | np.logical_or.reduceat(many[order], firsts)
    group = np.cumsum(~same) - 1
    found = np.empty(len(order), np.int64)
    found[order] = np.where(repeated, owner[order[firsts]], -1)[group]
    rows, at = [], 0
    for chunk, n in zip(chunks.tolist(), sizes.tolist(), strict=True):
        distinct, places = np.unique(np.append(-1, found[at : at + n]), return_inverse=True)
        rows.append((chunk, distinct.tolist(), places[1:].astype("<u4").tobytes()))
        at += n
    chunk, distinct, places = zip(*rows, strict=True)
    arrays = [pa.array(chunk, pa.int64()), pa.array([table["part"][0].as_py()] * len(rows), pa.int64()), pa.array(distinct, pa.list_(pa.int64())), pa.array(places, pa.binary())]
    return pa.table(arrays, ["chunk", "part", "owners", "places"])


def _stretches(starts: np.ndarray, doc: np.ndarray, shard: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(shard, document, first word, end) of windows joined where they touch and have one shard."""
    order = np.lexsort((starts, doc, shard))
    starts, doc, shard = starts[order], doc[order], shard[order]
    if len(starts):
        cut = (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] > starts[:-1] + size)
        first = np.flatnonzero(np.append(True, cut))
        last = np.append(first[1:], len(starts)) - 1
        yield from zip(shard[first].tolist(), doc[first].tolist(), starts[first].tolist(), (starts[last] + size).tolist(), strict=True)


def _cut(size: int):
    """The repeated stretches of a chunk's documents by owner, and those it owns as references."""

    def run(docs: pa.Table, owners: pa.Table) -> pa.Table:
        docs, owners = docs.sort_by("key"), owners.sort_by("part")
        starts, doc, hashes, first = [], [], [], 0
        texts, keys, wanted = (docs[c] for c in ("text", "key", "wanted"))
        for low, rows in slices(texts.combine_chunks()):
            words, counts, _ = _hashed(rows)
            windows, end = window_hashes(words, size), 0
            for k, n in enumerate(counts.tolist()):
                own = np.flatnonzero(np.unpackbits(np.frombuffer(wanted[low + k].as_py(), np.uint8), count=n))
                starts.append(own)
                doc.append(np.full(len(own), low + k))
                hashes.append(windows[end + own])
                end += n
        starts, doc, hashes = (np.concatenate(x) for x in (starts, doc, hashes))
        named = np.concatenate([np.array(o)[np.frombuffer(p, "<u4")] for o, p in zip(owners["owners"].to_pylist(), owners["places"].to_pylist(), strict=True)])
        _, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        shard = named[inverse]
        is_first = np.zeros(len(hashes), bool)
        is_first[at] = True
        mine = is_first & (shard >> 12 == docs["chunk"][0].as_py())
        parts = [(s, True, d, b, e) for s, d, b, e in _stretches(starts[mine], doc[mine], shard[mine], size)]
        some = shard >= 0
        parts += [(s, False, d, b, e) for s, d, b, e in _stretches(starts[some], doc[some], shard[some], size)]
        parts.sort(key=lambda p: p[2])
        made, split = [], (-1, [])
        for s, reference, d, b, e in parts:
            if split[0] != d:
                split = d, texts[d].as_py().encode().split()
            made.append((s, reference, keys[d].as_py(), b, e - b, b" ".join(split[1][b:e]).decode()))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*made, strict=True) if made else [[]] * 6
        return pa.table([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], [f.split(" ")[0] for f in PARTS.split(", ")])

    return run


def _match(size: int):
    """The covered stretches of the parts of documents that meet a shard."""

    def run(references: pa.Table, parts: pa.Table) -> pa.Table:
        automaton = SuffixAutomaton()
        for text in references["r_text"].to_pylist():
            automaton.add(text.encode().split())
        found = [
            (key, start + a, start + b)
            for key, start, text in zip(*(parts[c].to_pylist() for c in ("key", "start", "text")), strict=True)
            for a, b in automaton.covered(text.encode().split(), size)
        ]
        columns = zip(*found, strict=True) if found else [[]] * 3
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["key", "start", "end"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without the words of their covered stretches."""
    for batch in batches:
        made = []
        for doc_id, n, text, stretches in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words, kept, upto = text.encode().split(), [], 0
            for s in sorted(stretches or [], key=lambda s: (s["start"], s["end"])):
                kept += words[upto : s["start"]]  # empty where upto is past it
                upto = max(upto, s["end"])
            kept += words[upto:]
            made.append((doc_id, n, n - len(kept), sha256(b" ".join(kept)).hexdigest()))
        *numbers, digests = zip(*made, strict=True) if made else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string())], [f.split(" ")[0] for f in OUT.split(", ")])


def remove_repeated(
    docs: DataFrame, size: int = SIZE, bits: int = BITS, chunk_words: int = CHUNK, shard_windows: int = SHARD, range_hashes: int = RANGE, salt_words: int = SALT
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    array = spark.sparkContext.broadcast(anchor_bits(rows, size, bits))
    scanned = materialize(rows.mapInArrow(_scan(size, bits, array, chunk_words, shard_windows), SCANNED), folder, "scanned")
    chunks = scanned.where("hashes is not null")
    total = chunks.select(F.sum(F.length("many"))).first()[0] or 0
    ranges = 1 + total // range_hashes
    held = scanned.where("text is not null")

    blobs = chunks.select("chunk", "hashes", "shards", "many").mapInArrow(_by_range(ranges), "part long, chunk long, hashes binary, shards binary, many binary")
    owners = blobs.groupBy("part").applyInArrow(_owners, "chunk long, part long, owners array<long>, places binary")
    own = held.select("chunk", "key", "text", "wanted").withColumnRenamed("chunk", "own").withColumn("chunk", F.col("own"))
    cut = own.groupBy("own").cogroup(owners.groupBy("chunk")).applyInArrow(_cut(size), PARTS)
    parts = materialize(cut, folder, "parts")

    loads = parts.where("not reference").groupBy("shard").agg(F.sum("words").alias("words")).where(F.col("words") > salt_words)
    loads = small(materialize(loads.select("shard", F.expr(f"words div {salt_words}").alias("more")), folder, "loads"))
    more = F.coalesce("more", F.lit(0).cast("long"))
    met = parts.where("not reference").join(loads, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("key", "start"), more + 1))
    references = parts.where("reference").join(loads, "shard", "left").withColumn("r_salt", F.explode(F.sequence(F.lit(0).cast("long"), more)))
    references = references.select(F.col("shard").alias("r_shard"), "r_salt", F.col("text").alias("r_text"))
    pairs = references.groupBy("r_shard", "r_salt").cogroup(met.select("shard", "salt", "key", "start", "text").groupBy("shard", "salt"))
    covered = pairs.applyInArrow(_match(size), "key long, start long, end long")
    covered = covered.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("stretches"))
    finished = held.join(covered, "key", "left").select("doc_id", "n_words", "text", "stretches").mapInArrow(_finish, OUT)
    plain = scanned.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    out = materialize(plain.unionByName(finished), folder, "result")
    for name in ("scanned", "parts", "loads"):
        drop_folder(spark, f"{folder}/{name}")
    return out
