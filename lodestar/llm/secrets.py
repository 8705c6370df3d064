"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Method: a string of random characters falls apart into many tokens of a vocabulary made from ordinary text. A run of
key characters of at least MIN_RUN characters whose characters per token are below MAX_RATIO is a `random` span, after
excluding what is known to be no secret though it looks random: digests (hex of the usual lengths), UUIDs, numbers and
dates, and identifiers (words joined by separators and short numbers) whose words alone have as many letters per token as
ordinary text. Spans inside one of a pattern are not repeated.

Edge cases: null and empty texts have no spans. Offsets are code points, end exclusive. Repeated rows are scanned each;
other columns are kept as they are.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestar.llm.shared import free_name

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBERS = re.compile(r"[0-9]+(?:[-_/+][0-9]+)*")
MIN_RUN, MAX_RATIO = 20, 2.0
SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
SPANS = "array<struct<kind:string,start:int,end:int>>"


@functools.cache
def token_counter(path: str):
    """text -> number of its tokens under a tiktoken rank file."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def _known(run: str, tokens, max_ratio: float) -> bool:
    """Whether a run that falls apart into tokens is a digest, a UUID, numbers, or words of an identifier."""
    core = run.rstrip("=")
    if NUMBERS.fullmatch(core) or UUID.fullmatch(core) or (len(core) in DIGEST_LENGTHS and DIGEST.fullmatch(core)):
        return True
    if not IDENTIFIER.fullmatch(core):
        return False
    words = WORD.findall(core)
    return sum(map(len, words)) >= max_ratio * tokens(" ".join(words))


def scan(text: str | None, tokens, min_run: int = MIN_RUN, max_ratio: float = MAX_RATIO) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start, then kind in the order of KINDS."""
    if not text:
        return []
    low, found = text.lower(), []
    if any(word in low for word in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    added = []
    for m in RUN.finditer(text):
        run = m.group()
        if len(run) >= min_run and len(run) < max_ratio * tokens(run) and not _known(run, tokens, max_ratio):
            if not any(s <= m.start() and m.end() <= e for _, s, e in found):
                added.append(("random", *m.span()))
    return sorted(found + added, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, vocabulary: str, text: str = "text", spans: str = "spans", min_run: int = MIN_RUN, max_ratio: float = MAX_RATIO) -> DataFrame:
    """docs with a column of spans, an array of (kind, start, end); if docs has a column of that name, it stays and the new
    one is called spans_2 (see free_name). vocabulary: a tiktoken rank file on every executor."""

    @F.arrow_udf(SPANS)
    def spans_of(texts: pa.Array) -> pa.Array:
        tokens = token_counter(vocabulary)
        found = (scan(t.as_py(), tokens, min_run, max_ratio) for t in texts)
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in found], SPAN_LIST)

    # Not deterministic to Spark, so that several uses of the spans do not make it scan the texts again.
    return docs.withColumn(free_name(docs, spans), spans_of.asNondeterministic()(F.col(text).cast("string")))


def hide(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """text with each span, or run of overlapping spans, replaced by [SECRET]."""
    if not text or not found:
        return text
    parts, at = [], 0
    for _, start, end in sorted(found, key=lambda x: x[1]):
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with the spans of their texts hidden; hexadecimal strings of digest lengths only if digests."""

    @F.arrow_udf(StringType())
    def hidden(texts: pa.Array) -> pa.Array:
        tokens = token_counter(vocabulary)

        def one(value: str | None) -> str | None:
            found = scan(value, tokens)
            return hide(value, [s for s in found if digests or s[0] != "hex" or s[2] - s[1] not in DIGEST_LENGTHS])

        return pa.array((one(t.as_py()) for t in texts), pa.string())

    return docs.withColumn(text, hidden.asNondeterministic()(F.col(text).cast("string")))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
