"""Document fingerprints by locally consistent parsing.

Method: each level turns a sequence of names into a shorter one. Runs of one name become one name first. Deterministic
coin tossing then gives every name a label of a few values that depends only on the names just left of it, and that
differs from its neighbours' labels; local maxima of the labels begin phrases. A phrase's name is a hash of the names
in it. So equal substrings are cut alike but for a few names at their ends, wherever they stand. A fingerprint is a
sketch of a document's set of phrase names at LEVELS: BINS minima of hashes, 16 bits each, in hexadecimal; an empty bin
is ffff. The likeness of two fingerprints is the share of equal bins among those not empty in both.

Edge cases: null and empty texts have no phrases, so all bins are empty; two such are alike (1.0). Equal texts have
equal fingerprints. Texts shorter than a phrase are one phrase. Rows of one doc_id stand in the order of their texts;
null doc_ids come first. A single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from lodestar.llm.shared import mix

LEVELS = (2, 3)
BINS = 64
CHUNK = 400_000
BLOCKS = 8
EMPTY = 0xFFFF
_ONE = np.uint64(1)
_RUN = np.uint64(0x9FB21C651E98DF25)
_STEP = np.multiply.accumulate(np.full(64, np.uint64(0xD6E8FEB86659FD93)))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _toss_table() -> np.ndarray:
    """label by (left label, own label): twice the lowest bit where they differ, plus the own bit there."""
    left, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    apart = left ^ own
    low = np.bitwise_count(((apart & -apart) - 1) & 127).astype(np.int64)
    return (2 * low + ((own >> np.minimum(low, 7)) & 1)).astype(np.uint8).reshape(-1)


_TOSS = _toss_table()


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing, four times: 128, then 14, 8 and 6 labels. first: where documents begin."""
    apart = np.empty_like(names)
    apart[1:] = names[1:] ^ names[:-1]
    apart[first] = _ONE
    low = np.bitwise_count((apart & (~apart + _ONE)) - _ONE)
    label = 2 * low + ((names >> low.astype(np.uint64)) & _ONE).astype(np.uint8)
    for _ in range(3):
        index = np.empty(len(label), np.int32)
        index[1:] = label[:-1].astype(np.int32) * 128 + label[1:]
        index[first] = (label[first] ^ 1).astype(np.int32) * 128 + label[first]
        label = _TOSS[index]
    return label


def _next_level(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and the places where documents begin among them."""
    new = np.empty(len(names), bool)
    new[1:] = names[1:] != names[:-1]
    new[first] = True
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.concatenate([at, [len(names)]])).astype(np.uint64)
        first = np.searchsorted(at, first)
        names = names[at]
        many = length > 1
        names[many] = mix(names[many] ^ (length[many] * _RUN))
    label = _labels(names, first)
    begin = np.zeros(len(names), bool)
    begin[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    begin[first[1:] - 1] = False
    begin[first] = True
    at = np.flatnonzero(begin)
    size = np.diff(np.concatenate([at, [len(names)]]))
    place = np.arange(len(names)) - np.repeat(at, size)
    return mix(np.add.reduceat(names * _STEP[place & 63], at)), np.searchsorted(at, first)


def sketches(texts: list[str]) -> np.ndarray:
    """One row of BINS 16-bit values for each text."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    some = [k for k, d in enumerate(data) if d]
    if not some:
        return out
    sizes = np.array([len(data[k]) for k in some])
    names = _BYTE[np.frombuffer(b"".join(data[k] for k in some), np.uint8)]
    first = np.cumsum(sizes) - sizes
    keys = []
    for level in range(1, max(LEVELS) + 1):
        names, first = _next_level(names, first)
        if level in LEVELS:
            doc = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(np.concatenate([first, [len(names)]])))
            h = mix(names + np.uint64(level))
            keys.append(doc << np.uint64(38) | (h >> np.uint64(58)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF))
    keys = np.sort(np.concatenate(keys))
    slot = keys >> np.uint64(32)
    keys = keys[np.concatenate([[True], slot[1:] != slot[:-1]])]
    value = (mix(keys & np.uint64(0xFFFFFFFF)) % np.uint64(EMPTY)).astype(np.uint16)
    doc, bin_ = (keys >> np.uint64(38)).astype(np.int64), (keys >> np.uint64(32) & np.uint64(63)).astype(np.int64)
    out[np.array(some)[doc], bin_] = value
    return out


def likeness_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: the share of equal bins among those that are not empty in both; 1 where all are empty."""
    some = (a != EMPTY) | (b != EMPTY)
    return np.where(some.any(axis=1), ((a == b) & some).sum(axis=1) / np.maximum(some.sum(axis=1), 1), 1.0)


def to_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def from_text(prints: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(prints)), ">u2").astype(np.uint16).reshape(len(prints), BINS)


def _chunked(texts: list[str]) -> np.ndarray:
    parts, low, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k + 1 == len(texts):
            parts.append(sketches(texts[low : k + 1]))
            low, size = k + 1, 0
    return np.concatenate(parts) if parts else np.empty((0, BINS), np.uint16)


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """A text column's fingerprints."""
    return pd.Series(to_text(_chunked([t or "" for t in texts])), dtype=object)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """The likeness, 0 to 1, of two columns of fingerprints."""
    return pd.Series(likeness_of(from_text(a.tolist()), from_text(b.tolist())))


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, guest, doc_id, text) in order -> COMPARED, for all but guests, which only follow others."""

    def emit(rows: list, following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        after = [*texts[1:], following]
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, after, strict=True)]
        own, other = _chunked([*texts, following]), _chunked(edited)
        columns = [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array(to_text(own[:-1])),
            pa.array(to_text(other)),
            pa.array(likeness_of(own[:-1], other)),
            pa.array(likeness_of(own[:-1], own[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in COMPARED.split(", ")])

    held, size, block, ended = [], 0, None, False
    for batch in batches:
        for b, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if guest:
                if b == block and not ended:
                    yield emit(held, text)
                    held, size, ended = [], 0, True
                continue
            if b != block:
                block, ended = b, False
            elif size >= CHUNK:
                yield emit(held, text)
                held, size = [], 0
            held.append((doc_id, text))
            size += len(text)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint against that of its edited text and that of the next document by doc_id.

    The edited text has its last quarter replaced by the first code points of the next document. Documents are dealt to
    blocks of consecutive doc_ids, BLOCKS for each shuffle partition, so that partitions are even; the first document of
    a block is also sent to the block before as a guest, so the texts are shuffled once. Sent to the driver: a bound and
    a first doc_id per block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = BLOCKS * parts
    shares = [k / blocks for k in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("c")).first().c if shares else None
    bounds = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def block_of(ids: pd.Series) -> pd.Series:
        none = ids.isna().to_numpy()
        return pd.Series(np.where(none, 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64))).astype(np.int32))

    placed = docs.withColumn("block", block_of("doc_id"))
    low = F.min(F.expr("struct(doc_id is not null as known, doc_id as id)")).alias("low")
    starts = sorted((r.block, r.low.known, r.low.id) for r in placed.groupBy("block").agg(low).collect())
    before = {(k, i): starts[n - 1][0] for n, (_, k, i) in enumerate(starts)}

    @F.pandas_udf("array<struct<block:int,guest:boolean>>")
    def places(own: pd.Series, ids: pd.Series) -> pd.Series:
        out = []
        for b, i in zip(own, ids, strict=True):
            none = i is None or i != i
            guest = before.get((not none, None if none else int(i)))
            out.append([{"block": b, "guest": False}] + ([] if guest is None else [{"block": guest, "guest": True}]))
        return pd.Series(out)

    sent = placed.select("doc_id", "text", F.explode(places("block", "doc_id")).alias("place"))
    sent = sent.select("place.block", "place.guest", "doc_id", "text").repartition(parts, "block")
    return sent.sortWithinPartitions("block", "guest", "doc_id", "text").mapInArrow(_compare, COMPARED)
