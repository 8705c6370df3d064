"""Where rows go: documents by what they hold, queries by their kind, media by what a decoder can read, records by files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of queries and the column that each one fills (fixed values).
QUERY_KINDS = ("text", "video", "episode", "embedding", "segment", "frame")

# What the hardware decoder reads.
CODECS = ("mpeg1video", "mpeg2video", "mpeg4", "wmv3", "vc1", "h264", "hevc", "vp8", "vp9", "mjpeg", "av1")
UNSAFE_VP9_FORMATS = ("matroska", "webm")
MOST_WIDTH = MOST_HEIGHT = 4096


def _filled(c: Column) -> Column:
    """Whether a text is not empty, or another value is there."""
    return F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))


def document_route(vector: Column, content: Column, blob: Column | None = None) -> Column:
    """embedded: a vector that is not empty and no content; to_index: no vector, and content or a blob; else ambiguous."""
    blob = F.lit(None) if blob is None else blob
    has_vector = F.coalesce(F.size(vector) > 0, F.lit(False))
    indexed = vector.isNull() & (_filled(content) | blob.isNotNull())
    return F.when(has_vector & ~_filled(content), "embedded").when(indexed, "to_index").otherwise("ambiguous")


def route_documents(docs: DataFrame, vector: str = "embedding", content: str = "content", blob: str | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """The documents by route; if strict, an ambiguous one is an error."""
    routed = docs.withColumn("_route", document_route(F.col(vector), F.col(content), F.col(blob) if blob else None))
    if strict and routed.where("_route = 'ambiguous'").limit(1).count():
        raise ValueError("a document has both a vector and content, or neither")
    return {r: routed.where(F.col("_route") == r).drop("_route") for r in ("to_index", "embedded", "ambiguous")}


def query_kind(queries: DataFrame) -> Column:
    """The kind of each query: the one of its QUERY_KINDS columns that is not null; null if there is none or several."""
    there = [k for k in QUERY_KINDS if k in queries.columns]
    kinds = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in there]))
    return F.when(F.size(kinds) == 1, kinds[0])


def route_queries(queries: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    """The queries of each kind, with the columns other than those of kinds and `payload`, what the query holds. Payloads of
    episodes are decoded from base64. If strict, a query of no kind or several is an error."""
    kinds = queries.withColumn("_kind", query_kind(queries))
    if strict and kinds.where("_kind is null").limit(1).count():
        raise ValueError("a query is of no kind, or of several")
    rest = [c for c in queries.columns if c not in QUERY_KINDS]
    payload = {k: F.unbase64(F.col(k)) if k == "episode" else F.col(k) for k in QUERY_KINDS if k in queries.columns}
    return {k: kinds.where(F.col("_kind") == k).select(*rest, p.alias("payload")) for k, p in payload.items()}


def media_fault(codec: Column, formats: Column, width: Column, height: Column) -> Column:
    """Why media cannot be decoded, null if it can: an unknown codec, VP9 in a container without safe random access, or a
    frame that is too large. A size that is not known passes."""
    codec = F.lower(F.trim(codec))
    unsafe = F.arrays_overlap(F.transform(formats, F.lower), F.array(*map(F.lit, UNSAFE_VP9_FORMATS)))
    return (
        F.when(~F.coalesce(codec.isin(*CODECS), F.lit(False)), "codec")
        .when((codec == "vp9") & unsafe, "vp9 container")
        .when((width > MOST_WIDTH) | (height > MOST_HEIGHT), F.when(width.isNotNull() & height.isNotNull(), "too large"))
    )


def split_media(probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probes of decodable media, the others with their `fault`). probes: codec, formats (array), width, height."""
    marked = probes.withColumn("fault", media_fault(*map(F.col, ("codec", "formats", "width", "height"))))
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null")


def split_by_presence(records: DataFrame, files: DataFrame, path: str = "video_path") -> tuple[DataFrame, DataFrame]:
    """(records whose path is among the listed files, the others). files: path."""
    listed = files.select(F.col("path").alias(path)).distinct()
    return records.join(listed, path, "left_semi").select(records.columns), records.join(listed, path, "left_anti").select(records.columns)
