"""Batch embedding with a pluggable embedder, and deterministic stand-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 64
#: make() -> embed(texts) -> matrix; make runs once per task, where a model would be loaded.
Embedder = Callable[[], Callable[[list[str]], np.ndarray]]


def hash_embedder(dim: int) -> Embedder:
    """Hashed character trigrams: a text's vector depends on nothing but the text."""

    def make() -> Callable[[list[str]], np.ndarray]:
        power = np.uint64(0x9E3779B97F4A7C15)

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for k, t in enumerate(texts):
                points = np.frombuffer(f"  {t} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                grams = (points[:-2] * power + points[1:-1]) * power + points[2:]
                grams ^= grams >> np.uint64(29)
                grams *= power
                np.add.at(out[k], (grams >> np.uint64(33)).astype(np.int64) % dim, np.where(grams & np.uint64(1), 1.0, -1.0))
            return out

        return embed

    return make


def embed_column(df: DataFrame, column: str, embedder: Embedder, dim: int, into: str = "embedding", batch: int = BATCH) -> DataFrame:
    """df with a unit vector of each text, made in batches of at most `batch`; order, count and width are checked.

    A null text has a null vector, as has a vector of no length.
    """

    @F.pandas_udf("array<double>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = embedder()
        for s in series:
            out: list = [None] * len(s)
            known = [k for k, t in enumerate(s) if t is not None]
            for low in range(0, len(known), batch):
                part = known[low : low + batch]
                made = np.asarray(embed([s.iloc[k] for k in part]), dtype=float)
                if made.shape != (len(part), dim):
                    raise ValueError(f"the embedder made {made.shape} for {len(part)} texts of width {dim}")
                length = np.linalg.norm(made, axis=1)
                for k, v, n in zip(part, made, length, strict=True):
                    out[k] = v / n if 0 < n < np.inf else None
            yield pd.Series(out)

    return df.withColumn(into, vectors(column))


def random_vector(key: Column, dim: int, seed: int = 0) -> Column:
    """Uniform [0, 1) values of a hash of key, place and seed: the same however rows are partitioned."""
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.transform(F.sequence(F.lit(1), F.lit(dim)), draw)


def gaussian_vector(key: Column, dim: int, seed: int = 0) -> Column:
    """Normal values (Box-Muller on hashes), scaled to length 1 (divided by length + 1e-8)."""
    from lodestar.functions.vectors import l2_normalize

    u = lambda i, s: (F.pmod(F.xxhash64(F.lit(seed + s), key, i), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    draw = lambda i: F.sqrt(-2 * F.log(u(i, 1))) * F.cos(2 * F.pi() * u(i, 2))
    return l2_normalize(F.transform(F.sequence(F.lit(1), F.lit(dim)), draw), 1e-8)


def with_random_vectors(df: DataFrame, text: str, dim: int, most_chars: int, seed: int = 0, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with a random vector, rejected rows whose text is longer than most_chars); if strict, such a text is an error."""
    long_ = F.coalesce(F.char_length(text) > most_chars, F.lit(False))
    rejected = df.where(long_)
    if strict and rejected.limit(1).count():
        raise ValueError(f"a text is longer than {most_chars} characters")
    return df.where(~long_).withColumn("embedding", random_vector(F.col(text), dim, seed)), rejected
