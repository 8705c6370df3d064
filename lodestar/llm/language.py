"""Language identification of mixed-language text.

Method: the script of a word narrows the candidate languages; a word's score for a candidate is the sum of log
probabilities of its character n-grams; Viterbi's algorithm over the words of a text, with a penalty for each switch,
labels spans. A text's language is the one with most letters; its score is that language's share of the letters.

The model is learned from labelled rows: counts of hashed n-grams by language, and the scripts each language is written
in. At most about `per_language` rows of each language are used, chosen by a hash of doc_id (the documented bound of the
sample); the model has a fixed size per language.

Edge cases: null texts and texts without letters are `und` with score 0 and no spans. Without any labelled row every
text is `und`. More than MOST_LANGUAGES labels are an error. Rows with a null label are not learned from. Repeated rows are labelled each. Other columns are kept.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import free_name, mix

GRAMS = (2, 3)
BUCKETS = 1 << 16
SWITCH = 12.0
PER_LANGUAGE = 2000
#: A model has 65,536 numbers a language; more labels than this are refused.
MOST_LANGUAGES = 500
LEAST_SHARE = 0.01
BLOCK = 256
CHUNK = 250_000
RESULT = "struct<lang:string,score:double,spans:array<struct<lang:string,start:int,end:int>>>"
SPANS = pa.struct(
    [
        ("lang", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
    ]
)
#: Texts that are Python strings at a time.
ROWS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """By code point: lower-case form, script number (0: no letter); names of the scripts, from the letters' names."""
    lower, script, names = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8), {"": 0}
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            name = unicodedata.name(ch, "OTHER").split(" ")[0].split("-")[0]
            script[c] = names.setdefault(name, len(names)) if len(names) < 250 or name in names else 255
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
    script[0x20000:0x40000] = names.setdefault("CJK", len(names))
    return lower, script, tuple(names)


@dataclass(frozen=True)
class Words:
    """The words (runs of letters) of some texts: text number, start and end in code points there, script.

    grams: for each length, the buckets of n-grams and the word of each, ascending.
    """

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


def words_of(texts: list[str]) -> Words:
    lower, scripts, _ = _letters()
    sizes = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    script = scripts[points]
    letter = script > 0
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum(sizes)
    text = np.searchsorted(ends, begin, side="right")
    at = ends[text] - sizes[text]
    # n-grams end at each letter and at the space after a word; a space stands before each word
    low = np.where(letter, lower[points], np.uint32(32)).astype(np.uint64)
    inside = letter.copy()
    inside[np.minimum(stop, len(points) - 1)] = True
    where = np.flatnonzero(inside)
    word = np.cumsum(edge[:-1] == 1)[where] - 1
    depth = where - begin[word] + 1 if len(begin) else where
    grams = []
    h = np.zeros(len(where), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        back = where - (n - 1)
        h = h * _MIX + np.where(back >= 0, low[np.maximum(back, 0)], np.uint64(32)) + np.uint64(n)
        use = depth >= n - 1
        if n in GRAMS:
            grams.append(((mix(h[use]) % np.uint64(BUCKETS)).astype(np.int32), word[use]))
    return Words(text, begin - at, stop - at, script[begin], grams)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: log probability, less the mean over languages
    allowed: np.ndarray  # scripts x languages


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    low, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield low, texts[low:k]
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield low, texts[low:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of n-gram buckets (kind 0) and of scripts of words (kind 1) by language."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            grams, scripts = np.zeros(BUCKETS, np.int64), np.zeros(256, np.int64)
            for _, part in _chunks([t for g, t in zip(langs, texts, strict=True) if g == lang and t]):
                w = words_of(part)
                for buckets, _ in w.grams:
                    grams += np.bincount(buckets, minlength=BUCKETS)
                scripts += np.bincount(w.script, minlength=256)
            for kind, counts in ((0, grams), (1, scripts)):
                slot = np.flatnonzero(counts)
                arrays = [pa.array([lang] * len(slot), pa.string()), pa.array(np.full(len(slot), kind)), pa.array(slot), pa.array(counts[slot])]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "kind", "slot", "n"])


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from rows (doc_id, text, lang); about per_language rows of each language, by a hash of doc_id, are read."""
    known = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sizes = labelled.sparkSession.createDataFrame(sizes, "lang string, n long")
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(sizes), "lang").where(share < per_language / F.col("n")).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, kind long, slot long, n long")
    counts = counted.groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = tuple(sorted(counts.lang.unique()))
    table, scripts = np.full((BUCKETS, len(langs)), 0.5), np.zeros((256, len(langs)))
    column = counts.lang.map({g: k for k, g in enumerate(langs)}).to_numpy(int) if len(counts) else np.empty(0, int)
    for kind, into in ((0, table), (1, scripts)):
        rows = (counts.kind == kind).to_numpy()
        np.add.at(into, (counts.slot[rows].to_numpy(int), column[rows]), counts.n[rows].to_numpy(float))
    table = np.log(table / table.sum(axis=0)) if langs else table
    allowed = scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, (table - table.mean(axis=1, keepdims=True)).astype(np.float32) if langs else table, allowed)


def viterbi(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """The best label of each row of scores, where changing the label before row t costs penalty[t].

    Blocks of rows are solved side by side: first each block's best score from every label before it to every label at
    its end, then the labels between blocks, then the rows inside.
    """
    n, k = scores.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    size = min(BLOCK, n)
    blocks = -(-n // size)
    s = np.zeros((blocks * size, k))
    s[:n] = scores
    s = s.reshape(blocks, size, k)
    p = np.zeros(blocks * size)
    p[:n] = penalty
    p[n:] = 1e9
    p = p.reshape(blocks, size)
    through = np.full((blocks, k, k), -1e18)
    through[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(size):
        best = through.max(axis=2, keepdims=True) - p[:, t, None, None]
        through = np.maximum(through, best) + s[:, t, None, :]
    enter = np.zeros((blocks, k))
    for b in range(1, blocks):
        enter[b] = (enter[b - 1][:, None] + through[b - 1]).max(axis=0)
        enter[b] -= enter[b].max()
    back = np.empty((size, blocks, k), np.int16)
    now, own = enter, np.arange(k)
    for t in range(size):
        top = now.argmax(axis=1)
        best = now[np.arange(blocks), top] - p[:, t]
        switch = best[:, None] > now
        back[t] = np.where(switch, top[:, None], own)
        now = np.where(switch, best[:, None], now) + s[:, t]
    labels = np.empty((blocks, size), np.int64)
    # ends of blocks, from the last: a block's end is what the next block's first row came from
    at = int(now[-1].argmax())
    first = np.empty((blocks, k), np.int64)
    trace = np.broadcast_to(own, (blocks, k)).copy()
    for t in range(size - 1, -1, -1):
        trace = np.take_along_axis(back[t].astype(np.int64), trace, axis=1)
    first[:] = trace
    exits = np.empty(blocks, np.int64)
    for b in range(blocks - 1, -1, -1):
        exits[b] = at
        at = first[b, at]
    state = exits
    for t in range(size - 1, -1, -1):
        labels[:, t] = state
        state = back[t, np.arange(blocks), state].astype(np.int64)
    return labels.reshape(-1)[:n]


def label_texts(model: Model, texts: list[str | None], switch: float = SWITCH) -> list[dict]:
    """For each text its language, score and spans of one language."""
    out = [{"lang": "und", "score": 0.0, "spans": []} for _ in texts]
    if not model.langs:
        return out
    k = len(model.langs)
    for low, part in _chunks([t or "" for t in texts]):
        w = words_of(part)
        if not len(w.text):
            continue
        scores = np.zeros((len(w.text), k))
        for buckets, word in w.grams:
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            scores[word[cuts]] += np.add.reduceat(model.table[buckets], cuts, axis=0)
        scores[~model.allowed[w.script]] = -1e6
        new = np.concatenate([[True], w.text[1:] != w.text[:-1]])
        label = viterbi(scores, np.where(new, 0.0, switch))
        letters = np.zeros((len(part), k))
        np.add.at(letters, (w.text, label), w.end - w.start)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        for text in np.flatnonzero(total).tolist():
            out[low + text] |= {"lang": model.langs[top[text]], "score": float(letters[text, top[text]] / total[text])}
        begins = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))
        stops = np.concatenate([begins[1:], [len(label)]]) - 1
        for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
            span = {"lang": model.langs[label[b]], "start": int(w.start[b]), "end": int(w.end[e])}
            out[low + int(w.text[b])]["spans"].append(span)
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", into: str = "language", switch: float = SWITCH) -> DataFrame:
    """docs with a column `into`: struct of lang, score and spans (lang, start, end in code points); if docs has a column of
    that name, it stays and the new one is called into_2 (see free_name)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def labelled(texts: pa.Array) -> pa.Array:
        parts = [label_texts(sent.value, texts.slice(k, ROWS).to_pylist(), switch) for k in range(0, len(texts), ROWS)]
        return pa.array([row for part in parts for row in part], SPANS)

    # Not deterministic to Spark, so that a filter on the result does not make it compute the column twice.
    return docs.withColumn(free_name(docs, into), labelled.asNondeterministic()(F.col(text).cast("string")))
