"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Method: interval coalescing. Each token is an interval of byte offsets; the texts of a chunk lie end to end. All tokens of both
tokenizers are lexsorted by start, `maximum.accumulate` gives the furthest end so far, and a group breaks where a start reaches
it: there, tokens of both end. Within groups overlaps are expanded: at every distinct start one A token and one B token are
open, and each such pair of occurrences is a link (both tokenizers tile the same bytes, so a pair shares one stretch).

Where both vocabularies allow it (see cut_where), texts are first cut before spaces: both tokenizers end a token there, so the
distinct words of a chunk are tokenized and aligned once, all of them end to end, and texts are put together from them.

How often an id pair is linked in the whole corpus is summed from the distinct pairs of each chunk (about 4 MB of text, or one
longer text) and sent back to the chunks that have the pair, so neither all links nor all pairs are anywhere at once: texts
and ids never leave their task, the links of a document travel as codes of its chunk's pairs (two bytes each, four in chunks
of more than 65,536 pairs).

Edge cases: null and empty texts have no tokens: zeros, and '' as digest. So have texts whose joined token bytes differ from
space + text under either tokenizer (a B model may normalize). Strings of special tokens in texts are plain text. A null doc_id
is kept; rows are judged each by themselves, but all count in the corpus, repeated ones too. Other columns of docs are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.packing import byte_of_char, encoder, is_byte_level, read_vocabulary
from lodestar.llm.shared import drop_folder, materialize, shared_folder

CHUNK_BYTES = 4 << 20
#: Codes of a chunk's pairs take two bytes up to so many pairs.
NARROW = 1 << 16
#: Where texts are cut, and what keeps words from being all between single spaces.
CUT, DOUBLE = re.compile(r"(?<=\S)(?= [\s\S])"), re.compile(r"\s | \Z")
DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long"
LINKED = f"chunk long, {DOC}, groups_sha256 string, links binary, pairs array<long>, counts array<long>"
SCHEMA = f"{DOC}, n_best long, count_sum long, groups_sha256 string"


@functools.cache
def byte_tokens(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """text -> ids under a byte-level file of `tokenizers`, and the bytes of each id."""
    byte = byte_of_char()
    vocabulary = read_vocabulary(path)
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        table[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return encoder(path, special_as_text=True), table


@functools.cache
def piece_tokens(path: str) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """text -> ids under a sentencepiece model, and the bytes of each id: U+2581 is a space, byte pieces are that byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k)
        table.append(bytes([int(piece[3:-1], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode())
    return functools.partial(model.encode, num_threads=1), table


def coalesce(lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of tokens of two tokenizers that tile the same bytes, given by their lengths: the group of each A and of each B token,
    and the links, as places of their A and B tokens in byte order."""
    a, b = len(lengths_a), len(lengths_b)
    ends = np.concatenate([np.cumsum(lengths_a), np.cumsum(lengths_b)])
    starts = ends - np.concatenate([lengths_a, lengths_b])
    side = np.repeat(np.array([0, 1], np.int8), [a, b])
    order = np.lexsort((side, starts))
    start, is_b = starts[order], side[order] == 1
    furthest = np.maximum.accumulate(ends[order])
    opens = np.ones(a + b, bool)
    opens[1:] = start[1:] >= furthest[:-1]
    group = np.empty(a + b, np.int64)
    group[order] = np.cumsum(opens) - 1
    open_b = np.cumsum(is_b)
    last = np.flatnonzero(np.append(start[1:] > start[:-1], True)) if a + b else np.empty(0, np.int64)
    return group[:a], group[a:], last - open_b[last], open_b[last] - 1


def cut_where(path_a: str, pieces: list[bytes]) -> bool:
    """Whether texts may be cut before each space that follows another character: the pattern of byte-level files ends a token
    there, and no piece of the other vocabulary has a space behind another character."""
    return is_byte_level(path_a) and not any(b" " in piece.lstrip(b" ") for piece in pieces)


def cut(text: str) -> list[str]:
    """The words of space + text, each without the space it begins with."""
    if not DOUBLE.search(text) and not text.startswith(" "):
        return text.split(" ")
    return [w[1:] for w in CUT.split(f" {text}")]


def _ends(group: np.ndarray) -> np.ndarray:
    """Which tokens are the last of their group."""
    out = np.ones(len(group), bool)
    out[:-1] = group[1:] > group[:-1]
    return out


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _gather(sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places of all elements of the lists named by codes, where lists of the given sizes lie end to end."""
    n = sizes[codes]
    return np.repeat(_starts(sizes)[codes] - _starts(n), n) + np.arange(n.sum())


class Aligner:
    """Aligns the distinct words of texts."""

    def __init__(self, path_a: str, path_b: str) -> None:
        (self.encode_a, bytes_a), (self.encode_b, bytes_b) = byte_tokens(path_a), piece_tokens(path_b)
        self.bytes = bytes_a, bytes_b
        self.sizes = [np.array([len(x) for x in table], np.int64) for table in self.bytes]
        self.cuts = cut_where(path_a, bytes_b)
        # a token's number and what follows it: "," within its side, "|" after the last A, ";" after the last B of a group
        self.shown = [f"{k}{end}" for end in ",|" for k in range(len(bytes_a))] + [f"{k}{end}" for end in ",;" for k in range(len(bytes_b))]

    def words(self, text: str) -> list[str]:
        """The words of a text, or the whole text if it may not be cut; none if it is empty."""
        return (cut(text) if self.cuts else [text]) if text else []

    def _apart(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Whether each word's tokens have its bytes, and if so its A and B tokens: their numbers, and all end to end."""
        found = []
        for word in words:
            sides, raw = (self.encode_a(f" {word}"), self.encode_b(word)), f" {word}".encode()
            same = all(b"".join([table[k] for k in ids]) == raw for table, ids in zip(self.bytes, sides, strict=True))
            found.append(sides if same else None)
        numbers = [np.array([len(x[side]) if x else 0 for x in found], np.int64) for side in (0, 1)]
        flat = [np.array([k for x in found if x for k in x[side]], np.int64) for side in (0, 1)]
        return np.array([x is not None for x in found], bool), numbers, flat

    def _together(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """The same of words that end without white space, as one text, which has the same tokens."""
        text = " ".join(words)
        raw = f" {text}".encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        numbers, flat = [], []
        for ids, table, sizes in zip((self.encode_a(f" {text}"), self.encode_b(text)), self.bytes, self.sizes, strict=True):
            ids = np.array(ids, np.int64)
            upto = np.cumsum(sizes[ids])
            at = np.searchsorted(upto, ends)
            if b"".join([table[k] for k in ids.tolist()]) != raw or (upto[at] != ends).any():
                return self._apart(words)
            numbers.append(np.diff(np.append(-1, at)))
            flat.append(ids)
        return np.ones(len(words), bool), numbers, flat

    def align(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: whether it can be aligned, its A tokens, B tokens and shown groups; then the numbers of groups and
        links, and all links (B id, A id) in order."""
        odd = np.array([not self.cuts or len(w) > 1000 or not w or w[-1].isspace() or "▁" in w for w in words], bool)
        plain = [w for w, o in zip(words, odd.tolist(), strict=True) if not o]
        halves = [self._together(plain)] if plain else []
        halves.append(self._apart([w for w, o in zip(words, odd.tolist(), strict=True) if o]))
        place = np.argsort(np.argsort(odd, kind="stable"), kind="stable")  # of each word: plain ones first
        good = np.concatenate([h[0] for h in halves])[place]
        (n_a, a), (n_b, b) = ((np.concatenate([h[1][side] for h in halves]), np.concatenate([h[2][side] for h in halves])) for side in (0, 1))
        a, b = a[_gather(n_a, place)], b[_gather(n_b, place)]
        n_a, n_b = n_a[place], n_b[place]
        group_a, group_b, link_a, link_b = coalesce(self.sizes[0][a], self.sizes[1][b])
        word_a = np.repeat(np.arange(len(words)), n_a)
        ends_a, ends_b = _ends(group_a), _ends(group_b)
        n_groups = np.bincount(word_a[ends_a], minlength=len(words))
        n_links = np.bincount(word_a[link_a], minlength=len(words))
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([group_a, group_b])))
        number = np.concatenate([a + len(self.bytes[0]) * ends_a, b + 2 * len(self.bytes[0]) + len(self.bytes[1]) * ends_b])[order].tolist()
        parts, shown, at = [self.shown[k] for k in number], [], 0
        for n in (n_a + n_b).tolist():
            shown.append("".join(parts[at : at + n]))
            at += n
        return good, n_a, n_b, shown, n_groups, n_links, b[link_b] << 32 | a[link_a]


def _link(path_a: str, path_b: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        held, words, size = [], {}, 0

        def out() -> pa.RecordBatch:
            ids, codes = zip(*held, strict=True)
            good, n_a, n_b, shown, n_groups, n_links, links = aligner.align(list(words))
            codes = [c if good[c].all() else c[:0] for c in codes]
            flat = np.concatenate(codes)
            used = np.zeros(len(good), bool)
            used[flat] = True
            pairs, of_link = np.unique(links[np.repeat(used, n_links)], return_inverse=True)
            kind = "<u2" if len(pairs) <= NARROW else "<u4"
            place = np.zeros(len(links), kind)
            place[np.repeat(used, n_links)] = of_link
            times = np.bincount(flat, minlength=len(good))
            counts = np.bincount(place, np.repeat(times, n_links), minlength=len(pairs))[: len(pairs)].astype(np.int64)
            digests = [sha256("".join([shown[k] for k in c.tolist()])[:-1].encode()).hexdigest() if len(c) else "" for c in codes]
            blobs = [place[_gather(n_links, c)].tobytes() for c in codes]
            sums = [[int(n[c].sum()) for c in codes] for n in (n_a, n_b, n_groups, n_links)]
            last = [None]  # the row of the chunk's pairs
            longs = [pa.array([*x, None], pa.int64()) for x in (ids, *sums)]
            lists = [pa.array([None] * len(ids) + [x], pa.list_(pa.int64())) for x in (pairs, counts)]
            arrays = [pa.array([chunk] * (len(ids) + 1), pa.int64()), *longs, pa.array(digests + last, pa.string()), pa.array(blobs + last, pa.binary()), *lists]
            return pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in LINKED.split(", ")])

        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py() or ""
                own = [words.setdefault(w, len(words)) for w in aligner.words(text)]
                held.append((doc_id, np.array(own, np.int32)))
                size += len(text)
                if size >= chunk_bytes:
                    yield out()
                    chunk, held, words, size = chunk + 1, [], {}, 0
        if held:
            yield out()

    return run


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links; pairs: code, total and whether its B id's highest."""
    n = len(pairs)
    total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        at = pairs["code"].to_numpy()
        total[at] = pairs["total"].to_numpy()
        best[at] = pairs["best"].to_numpy(zero_copy_only=False)
    kind = "<u2" if n <= NARROW else "<u4"
    codes = [np.frombuffer(x, kind) for x in docs["links"].to_pylist()]
    sums = {"n_best": [int(best[c].sum()) for c in codes], "count_sum": [int(total[c].sum()) for c in codes]}
    fields = [f.split(" ")[0] for f in SCHEMA.split(", ")]
    return pa.table([pa.array(sums[f], pa.int64()) if f in sums else docs[f] for f in fields], fields)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level file of the `tokenizers` library, applied to space + text; path_b: a sentencepiece model that adds
    the space itself; both at the same path on every executor. n_best counts the links whose id pair is linked as often as
    any pair of its B id, count_sum sums over links how often their pair is linked in all of docs.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    linked = materialize(rows.mapInArrow(_link(path_a, path_b, chunk_bytes), LINKED), folder, "linked")
    known = linked.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "p"))
    known = known.select("chunk", "code", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    # A B id is linked with at most as many ids as A has, so the window's groups are bounded by the vocabulary.
    totals = known.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.shiftright("pair", 32))
    totals = totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b"))).drop("b")
    back = known.join(totals, "pair").select("chunk", "code", "total", "best")
    own = linked.where("n_a is not null").drop("pairs", "counts").withColumnRenamed("chunk", "own")
    out = own.groupBy("own").cogroup(back.groupBy("chunk")).applyInArrow(_score, SCHEMA)
    out = materialize(out, folder, "aligned")
    drop_folder(spark, f"{folder}/linked")
    return out


def token_groups(text: str, path_a: str, path_b: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, as lists of A and B ids; none if the bytes of a tokenizer differ from space + text."""
    aligner = Aligner(path_a, path_b)
    good, _, _, shown, *_ = aligner.align(aligner.words(text))
    if not text or not good.all():
        return []
    sides = (group.split("|") for group in "".join(shown)[:-1].split(";"))
    return [tuple([int(k) for k in side.split(",")] for side in group) for group in sides]
