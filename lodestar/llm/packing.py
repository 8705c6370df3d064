"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

Method: the cost of a piece of n tokens is n + n^2 / length (linear layers plus attention within the piece). Within a
block of documents, pieces go in descending size to the sequence of lowest cost that still has room; the number of
sequences is the least that holds the block, so less than one sequence of padding is left in a block. A piece that no
sequence of the block has room for is cut at the room of the cheapest.

One pass over the partitions, without a shuffle: a task tokenizes its rows, packs every `block_tokens` tokens and
forgets them. What a task holds is one block and its longest document.

Edge cases: null and empty texts are the end token alone. A null doc_id is kept. Repeated rows are packed each. Other
columns of docs are ignored. An empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: tiktoken looks back from the end of white space, which takes stack for each character; longer runs go to `tokenizers`.
LONGEST_BLANK = 1 << 16
BLANK = re.compile(r"\s+")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest follows from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def _library(path: str, special_as_text: bool):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


@functools.cache
def read_vocabulary(path: str) -> dict[str, int]:
    """The tokens of a file of the `tokenizers` library and their ids, added ones too."""
    return _library(path, False).get_vocab(with_added_tokens=True)


def has_long_blank(text: str, most: int = LONGEST_BLANK) -> bool:
    """Whether a run of white space is longer than tiktoken's regular expression is given."""
    return len(text) > most and any(m.end() - m.start() > most for m in BLANK.finditer(text))


def is_byte_level(path: str) -> bool:
    """Whether a file of the `tokenizers` library cuts plain texts by PATTERN and nothing else."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = spec.get("pre_tokenizer") or {}
    alone = not spec.get("normalizer") and not split.get("add_prefix_space") and all(t.get("special") for t in spec.get("added_tokens", []))
    return alone and split.get("type") == "ByteLevel" and split.get("use_regex", True)


@functools.cache
def encoder(path: str, special_as_text: bool = False) -> Callable[[str], list[int]]:
    """text -> ids as the `tokenizers` library gives them for this file, without added special tokens.

    Where the vocabulary is a byte-level BPE whose ids follow its merges, tiktoken computes the same ids about four times
    as fast; texts that hold the string of an added token (unless special_as_text, which makes it plain text), texts with
    very long white space, and all other vocabularies go to `tokenizers`.
    """

    def exact(text: str) -> list[int]:
        return _library(path, special_as_text).encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocab = model.get("vocab", {})
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and split.get("type") == "ByteLevel"
        and not split.get("add_prefix_space")
        and split.get("use_regex", True)
        and not model.get("unk_token")
        and all(vocab.get("".join(m)) == 256 + k for k, m in enumerate(merges))
    )
    if not plain:
        return exact
    import tiktoken

    byte = byte_of_char()
    added = [t["content"] for t in spec.get("added_tokens", [])]
    apart = [t["content"] for t in spec.get("added_tokens", []) if not (special_as_text and t.get("special"))]
    ranks = {bytes(byte[c] for c in token): k for token, k in vocab.items() if token not in added}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def quick(text: str) -> list[int]:
        return exact(text) if any(a in text for a in apart) or has_long_blank(text) else fast.encode_ordinary(text)

    return quick


def assign(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, tokens, sequence, offset) of documents of the given sizes.

    Pieces come in descending size, so a sequence without room for one is set aside, by its room, until pieces are small
    enough for it: all open sequences are considered for every piece.
    """
    total = sum(sizes)
    sequences = -(-total // length)
    pieces, rest, filled = [], [], 0
    for k, n in enumerate(sizes):
        cut = n - n % length
        for start in range(0, cut, length):
            pieces.append((k, start, length, filled, 0))
            filled += 1
        if n > cut:
            rest.append((cut - n, k, cut))
    heapq.heapify(rest)
    cost, used = [0.0] * sequences, [0] * sequences
    fitting = [(0.0, s) for s in range(filled, sequences)]
    every = list(fitting)
    aside: list[tuple[int, float, int]] = []

    def cheapest(heap: list[tuple]) -> tuple | None:
        """The first entry of a heap that still holds: a sequence's cost has grown since others were made."""
        while heap and (heap[0][-2] != cost[heap[0][-1]] or used[heap[0][-1]] == length):
            heapq.heappop(heap)
        return heap[0] if heap else None

    while rest:
        minus, k, start = heapq.heappop(rest)
        n = -minus
        while cheapest(aside) and -aside[0][0] >= n:
            heapq.heappush(fitting, heapq.heappop(aside)[1:])
        while cheapest(fitting) and used[fitting[0][1]] + n > length:
            c, s = heapq.heappop(fitting)
            heapq.heappush(aside, (used[s] - length, c, s))
        s = (cheapest(fitting) or cheapest(every))[1]
        take = min(n, length - used[s])
        pieces.append((k, start, take, s, used[s]))
        used[s] += take
        cost[s] += take + take * take / length
        heapq.heappush(fitting, (cost[s], s))
        heapq.heappush(every, (cost[s], s))
        if take < n:
            heapq.heappush(rest, (take - n, k, start + take))
    return pieces


def _pack(path: str, end_id: int, length: int, block_tokens: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        first = TaskContext.get().partitionId() << 32
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                block.append((doc_id, np.array(ids, dtype="<u4")))
                held += len(ids)
                if held >= block_tokens:
                    yield out(block, first)
                    first += -(-held // length)
                    block, held = [], 0
        if block:
            yield out(block, first)

    def out(block: list[tuple], first: int) -> pa.RecordBatch:
        rows = []
        for k, start, n, s, offset in assign([len(ids) for _, ids in block], length):
            doc_id, ids = block[k]
            part = ids[start : start + n]
            rows.append((doc_id, start, n, zlib.crc32(part.tobytes()), len(ids), first + s, offset, part.view("<i4") if with_ids else None))
        *numbers, parts = zip(*rows, strict=True)
        arrays = [*(pa.array(x, pa.int64()) for x in numbers), pa.array(parts, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in SCHEMA.split(", ")])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, block_tokens: int = 1 << 20, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    tokenizer: a file of the `tokenizers` library, at the same path on every executor. Sequence ids hold the number of
    the partition, so they are unique; a piece's ids are null unless with_ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, end_id, length, block_tokens, with_ids), SCHEMA)
