"""Aligned tokens against a search of all pairs of intervals, with the libraries called plainly."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import alignment, queries
from lodestar.llm.packing import byte_of_char

A, B = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def intervals(lengths):
    ends = np.cumsum(lengths).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def brute_groups(a, b):
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append(([k for k, (s, e) in enumerate(a) if low <= s and e <= cut], [k for k, (s, e) in enumerate(b) if low <= s and e <= cut]))
        low = cut
    return groups


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=40), st.lists(st.booleans(), min_size=1, max_size=40))
def test_coalesced_intervals(x, y):
    n = min(len(x), len(y))
    sides = []
    for cuts in (x[:n], y[:n]):
        at = [k + 1 for k in range(n - 1) if cuts[k]] + [n]
        sides.append(np.diff([0, *at]))
    group_a, group_b, link_a, link_b = alignment.coalesce(*sides)
    a, b = (intervals(s) for s in sides)
    links = [(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if s < f and t < e]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == links
    groups = brute_groups(a, b)
    assert [([k for k in range(len(a)) if group_a[k] == g], [k for k in range(len(b)) if group_b[k] == g]) for g in range(len(groups))] == groups
    assert group_a[-1] == group_b[-1] == len(groups) - 1


def brute(rows):
    one, other = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte, counts, found = byte_of_char(), Counter(), []
    for doc_id, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = other.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in one.id_to_token(k)) for k in a]
        bytes_b = [bytes([int(p[1:-1], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(other.id_to_piece, b)]
        whole = (" " + text).encode() if text else b""
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            a, b, bytes_a, bytes_b = [], [], [], []
        at_a, at_b = (intervals([len(x) for x in side]) if side else [] for side in (bytes_a, bytes_b))
        links = [(a[i], b[j]) for i, (s, e) in enumerate(at_a) for j, (t, f) in enumerate(at_b) if s < f and t < e]
        counts.update(links)
        groups = [([a[k] for k in x], [b[k] for k in y]) for x, y in brute_groups(at_a, at_b)]
        found.append((doc_id, len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for doc_id, n_a, n_b, groups, links in found:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(counts[x] == highest[x[1]] for x in links)
        digest = sha256(shown.encode()).hexdigest() if groups else ""
        yield doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts[x] for x in links), digest


TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "Hello world"), (5, "Hello world"), (5, "Hello world"), (None, "naïve café 日本語 🙂 tokens"), (6, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (7, "▁under▁line"), (8, "tab\tnew\nline\r\n  two   spaces "), (9, "\x00\x01\x7f\u0085 　x"), (10, "don't won't I'll 12345 3.14 #@!"), (11, "ﬁ ½ Å é ﻿"),
    (12, "-" * 70 + "a" * 70), (13, "Größe äöü ß straße"), (-3, "وعربي עברית"),
]


@pytest.mark.parametrize("chunk_bytes", [1, 60, 1 << 22])
def test_edges_against_all_pairs(spark, chunk_bytes):
    docs = spark.createDataFrame([(d, t, k, "c") for k, (d, t) in enumerate(TEXTS)], "doc_id long, text string, chunk int, n_a string").coalesce(2)
    got = alignment.align_tokens(docs, A, B, chunk_bytes)
    expected = list(brute(TEXTS))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert {t for (d, t), e in zip(TEXTS, expected, strict=True) if t and not e[1]} <= {"▁under▁line"}
    assert alignment.align_tokens(docs.limit(0), A, B).count() == 0


def test_groups_of_one_text():
    for _, text in TEXTS:
        groups = alignment.token_groups(text or "", A, B)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert (sha256(shown.encode()).hexdigest() if groups else "") == next(iter(brute([(0, text)])))[-1]


def test_chunks_of_many_pairs(spark):
    """More than 65,536 pairs in a chunk take wider codes."""
    rng = np.random.default_rng(1)
    pieces = [p.decode() for p in alignment.piece_tokens(B)[1] if p.strip().isalpha() and p.isascii()]
    texts = [(k, "".join(rng.choice(pieces, 40_000))) for k in range(12)]
    got = alignment.align_tokens(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), A, B, 1 << 30)
    counts, rows = Counter(), {}
    for k, text in texts:
        links = [(a, b) for x, y in alignment.token_groups(text, A, B) for a, b in zip(*(np.array(s)[i].tolist() for s, i in zip((x, y), _spread(x, y), strict=True)), strict=True)]
        counts.update(links)
        rows[k] = links
    assert len(counts) > alignment.NARROW
    assert {r.doc_id: r.count_sum for r in got.collect()} == {k: sum(counts[x] for x in links) for k, links in rows.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(" \n\t\x1f\u00a0\u2003ab'1.é-"), max_size=60))
def test_words_are_tokenized_as_in_the_whole_text(text):
    words = [" " + w for w in alignment.cut(text)]
    assert "".join(words) == " " + text
    assert all(not w[-1].isspace() for w in words[:-1])
    (encode_a, _), (encode_b, _) = alignment.byte_tokens(A), alignment.piece_tokens(B)
    assert alignment.cut_where(A, alignment.piece_tokens(B)[1])
    assert [k for w in words for k in encode_a(w)] == Tokenizer.from_file(A).encode(" " + text).ids
    assert [k for w in words for k in encode_b(w[1:])] == encode_b(text) or not text


def test_texts_that_may_not_be_cut():
    assert not alignment.cut_where(A, [b" a", b"b c"])
    assert not alignment.cut_where(queries.tokenizer("word_bpe_49k.json"), [b" a"])


def _spread(x, y):
    (_, a), (_, b) = alignment.byte_tokens(A), alignment.piece_tokens(B)
    _, _, i, j = alignment.coalesce(np.array([len(a[k]) for k in x]), np.array([len(b[k]) for k in y]))
    return i, j


def test_very_long_texts(spark):
    texts = [(1, " " * 1_000_000), (2, "a" * 300_000), (3, "word " * 400_000), (4, "\n" * 200_000 + "x"), (5, "é" * 100_000)]
    got = {r.doc_id: r for r in alignment.align_tokens(spark.createDataFrame(texts, "doc_id long, text string"), A, B).collect()}
    assert all(got[k].n_links == got[k].n_a + got[k].n_b - got[k].n_groups > 0 for k, _ in texts)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents")
    short = docs.where("n_chars < 4000 or n_chars is null")
    rows = [(r.doc_id, r.text) for r in short.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.align_tokens(short, A, B).collect())) == sorted(brute(rows))
    assert queries.op12_token_alignment(spark, folder).count() == docs.count()
