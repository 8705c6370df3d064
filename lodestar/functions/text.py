"""Column expressions over ids, paths, URLs, MIME types and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0")
DEFAULT_MIME = "application/octet-stream"
#: MIME type by file extension (fixed values of common registries).
MIME = {
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mov": "video/quicktime",
    "avi": "video/x-msvideo",
    "mkv": "video/x-matroska",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "txt": "text/plain",
    "html": "text/html",
    "csv": "text/csv",
    "json": "application/json",
    "pdf": "application/pdf",
}
#: States of a load job by number.
JOB_STATES = {0: "pending", 1: "failed", 2: "started", 5: "persisted", 6: "completed", 7: "failed_and_cleaned"}


def hash_id(columns: list[Column]) -> Column:
    """One column: its text; several: sha256 of their texts joined by `_`, nulls as None; none: a random UUID."""
    texts = [F.coalesce(c.cast("string"), F.lit("None")) for c in columns]
    if not texts:
        return F.expr("uuid()")
    return texts[0] if len(texts) == 1 else F.sha2(F.concat_ws("_", *texts), 256)


def path_id(path: Column) -> Column:
    return F.sha2(path, 256)


def safe_name(name: Column) -> Column:
    """Letters, digits and `_` only, not beginning with a digit, at most 255 characters; null for an empty name."""
    plain = F.regexp_replace(name, "[^0-9A-Za-z_]", "_")
    lead = F.when(plain.rlike("^[A-Za-z_]"), plain).otherwise(F.concat(F.lit("a"), plain))
    return F.when(F.length(name) > 0, F.substring(lead, 1, 255))


def valid_id(column: Column, most: int = 100) -> Column:
    return F.coalesce(column.rlike("^[a-zA-Z0-9_-]+$") & (F.char_length(column) <= most), F.lit(False))


def is_uuid(column: Column) -> Column:
    return F.coalesce(column.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), F.lit(False))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def relative_key(path: Column, base: str) -> Column:
    """path below base, without a leading `/`; null where path is not below it."""
    rest = F.regexp_replace(F.substring(path, F.lit(len(base) + 1), F.length(path)), "^/+", "")
    return F.when(F.startswith(path, F.lit(base)), rest)


def bucket_and_key(uri: Column) -> tuple[Column, Column]:
    """Bucket and key of an s3:// URI; null for others."""
    ok = uri.rlike("^s3://[^/]+/")
    return tuple(F.when(ok, F.regexp_extract(uri, "^s3://([^/]+)/(.*)$", k)) for k in (1, 2))


def guess_mime(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(known[extension(path)], F.lit(DEFAULT_MIME))


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(http|https|ftp|ftps)://.+"), F.lit(False))


def s3_path_fault(path: Column) -> Column:
    """Why a path is no plain s3://bucket/key; null if it is one."""
    return (
        F.when(path.isNull() | ~path.rlike("^s3://"), "scheme")
        .when(~path.rlike("^s3://[a-z0-9][a-z0-9.-]+/."), "bucket or key")
        .when(path.rlike(r"[*?\[\]]"), "glob or query")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "parent folder")
        .when(path.rlike(r"[\x00-\x1f\x7f]"), "control character")
    )


def is_local_url(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1).isin(*LOCAL_HOSTS), F.lit(False))


def quote_path(path: Column) -> Column:
    """Percent-encode each part of a path; a space becomes %20."""
    part = F.transform(F.split(path, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.array_join(part, "/")


def media_kind(uri: Column) -> Column:
    """base64, presigned_url, frames or text, by the head of a media URI."""
    return (
        F.when(uri.rlike("^data:[a-z]+/[a-z0-9.+-]+;base64,"), "base64")
        .when(uri.rlike("^data:[a-z]+/[a-z0-9.+-]+;presigned_url,"), "presigned_url")
        .when(uri.rlike("^data:[a-z]+/[a-z0-9.+-]+;frames,"), "frames")
        .otherwise("text")
    )


def media_type(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^data:([a-z]+/[a-z0-9.+-]+);", 1), F.lit(""))


def media_payload(uri: Column) -> Column:
    return F.when(media_kind(uri) != "text", F.regexp_extract(uri, "(?s)^data:[^,]*,(.*)$", 1))


def frames_are_whole(uri: Column, frames: int = 8) -> Column:
    parts = F.split(media_payload(uri), ",")
    return (F.size(parts) == frames) & ~F.exists(parts, lambda p: p == "")


def media_uri(source: Column, extension_: Column) -> Column:
    """A data URI for a URL or for base64 text; data URIs stay. Unknown extensions count as mp4."""
    kind = F.concat(F.lit("data:video/"), F.coalesce(F.nullif(extension_, F.lit("")), F.lit("mp4")))
    return (
        F.when(source.rlike("^data:"), source)
        .when(is_url(source), F.concat(kind, F.lit(";presigned_url,"), source))
        .otherwise(F.concat(kind, F.lit(";base64,"), source))
    )


def encode_b64(text: Column, most_bytes: int) -> Column:
    """base64 of the UTF-8 bytes; null where they are more than most_bytes."""
    return F.when(F.octet_length(text) <= most_bytes, F.translate(F.base64(text.cast("binary")), "\r\n", ""))


def prepare_text(text: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.translate(text, "\n", " "), F.lit(suffix))


def word_count(text: Column) -> Column:
    """Words between white space, at least 1."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.greatest(F.lit(1), F.size(words)).cast("long")


def input_kind(value: Column) -> Column:
    return F.when(value.rlike("^data:video/"), "video").otherwise("text")


def fill_nan(column: Column) -> Column:
    return F.coalesce(F.nanvl(column, F.lit(0.0)), F.lit(0.0))


def state_name(state: Column) -> Column:
    names = F.create_map(*[x for k, v in JOB_STATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(names[state], F.lit("unknown"))


def fill_template(template: Column, meta: Column, keys: list[str], first_only: bool = False) -> Column:
    """Replace {{key}} of a template by metadata; absent keys stay as they are."""
    out = template
    for key in keys[:1] if first_only else keys:
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(meta[key], F.lit("{{" + key + "}}")))
    return out
