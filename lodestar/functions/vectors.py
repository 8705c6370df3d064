"""Column expressions over vectors (arrays of numbers). Sums are taken in double precision."""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product (score_ip)."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; smaller is nearer."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


#: name -> (expression, whether a larger score is better)
METRICS = {"ip": (dot, True), "cosine": (cosine, True), "l2": (squared_l2, False)}


def l2_normalize(a: Column, eps: float = 0.0) -> Column:
    """a / (|a| + eps); null where that is zero or a component is not finite.

    The length is bound to a variable, as an expression inside a lambda would be evaluated again for every component.
    """

    def scaled(n: Column) -> Column:
        sound = (n > 0) & (n < float("inf")) & ~F.isnan(n)
        return F.when(sound, F.transform(a, lambda x: x.cast("double") / n))

    return F.transform(F.array(norm(a) + F.lit(eps)), scaled)[0]


def has_dim(a: Column, dim: int) -> Column:
    return F.coalesce(F.size(a) == dim, F.lit(False))


def affine(a: Column, coef: Sequence[float], intercept: float) -> Column:
    """a . coef + intercept."""
    return dot(a, F.array(*[F.lit(float(c)) for c in coef])) + F.lit(float(intercept))


def gaussian_nll(log_pi: Column, mu: Column, sigma: Column, y: Column) -> Column:
    """-log of the density at y of a mixture of normals: arrays of log weights, means and deviations."""
    parts = F.zip_with(
        log_pi,
        F.arrays_zip(mu.alias("m"), sigma.alias("s")),
        lambda p, c: p - F.log(c["s"]) - F.lit(0.9189385332046727) - (y - c["m"]) * (y - c["m"]) / (2 * c["s"] * c["s"]),
    )
    top = F.array_max(parts)
    return -(top + F.log(_sum(F.transform(parts, lambda x: F.exp(x - top)))))


def encode_vectors(vectors: Column) -> Column:
    """Vectors as base64 of little-endian 32-bit floats. The floats of an Arrow batch become bytes at once."""

    @F.arrow_udf("string")
    def packed(column: pa.Array) -> pa.Array:
        column = column.cast(pa.large_list(pa.float32()))
        data = memoryview(np.ascontiguousarray(column.values, "<f4").tobytes())
        ends = np.asarray(column.offsets, np.int64) * 4
        texts = [b64encode(data[a:b]).decode() if good else None for a, b, good in zip(ends[:-1].tolist(), ends[1:].tolist(), column.is_valid().to_pylist(), strict=True)]
        return pa.array(texts, pa.string())

    return packed(vectors)


def decode_vectors(texts: Column) -> Column:
    """The vectors of such texts; the bytes of an Arrow batch become floats at once. A text of another length is an error."""

    @F.arrow_udf("array<float>")
    def unpacked(column: pa.Array) -> pa.Array:
        parts = [None if t is None else b64decode(t, validate=True) for t in column.to_pylist()]
        if any(p is not None and len(p) % 4 for p in parts):
            raise ValueError("a text holds no whole number of floats")
        flat = np.frombuffer(b"".join(p or b"" for p in parts), "<f4")
        ends = np.cumsum([0, *(len(p or b"") // 4 for p in parts)])
        mask = pa.array([p is None for p in parts])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.float32()), mask=mask)

    return unpacked(texts)
