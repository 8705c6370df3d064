import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_assignment(sizes):
    pieces = packing.assign(sizes, 512)
    for k, n in enumerate(sizes):
        own = sorted((start, size) for d, start, size, _, _ in pieces if d == k)
        assert [s for s, _ in own] == np.cumsum([0, *(x for _, x in own)])[:-1].tolist() and sum(x for _, x in own) == n
    used = {}
    for _, _, size, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert used.get(s, 0) == offset and size > 0
        used[s] = offset + size
    assert all(u <= 512 for u in used.values())
    assert len(used) == -(-sum(sizes) // 512)


def test_costs_are_balanced():
    rng = random.Random(1)
    sizes = [rng.randint(10, 400) for _ in range(600)]
    cost = {}
    for _, _, n, s, _ in packing.assign(sizes, 2048):
        cost[s] = cost.get(s, 0) + n + n * n / 2048
    assert np.std(list(cost.values())) / np.mean(list(cost.values())) < 0.1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=80))
def test_pieces_go_to_the_cheapest_sequence_with_room(sizes):
    """Against a search of all open sequences for every piece; a document is cut only where none has room for it."""
    rest = sorted(((-(n % 512), k, n - n % 512) for k, n in enumerate(sizes) if n % 512))
    sequences = -(-sum(sizes) // 512) - sum(n // 512 for n in sizes)
    cost, used = [0.0] * sequences, [0] * sequences
    expected = []
    while rest:
        minus, k, start = rest.pop(0)
        fits = [s for s in range(sequences) if used[s] - minus <= 512]
        s = min(fits, key=lambda s: (cost[s], s)) if fits else min((s for s in range(sequences) if used[s] < 512), key=lambda s: (cost[s], s))
        take = min(-minus, 512 - used[s])
        expected.append((k, start, take, s, used[s]))
        used[s], cost[s] = used[s] + take, cost[s] + take + take * take / 512
        if take < -minus:
            rest = sorted([*rest, (minus + take, k, start + take)])
    first = sum(n // 512 for n in sizes)
    got = [(k, start, n, s - first, at) for k, start, n, s, at in packing.assign(sizes, 512) if s >= first]
    assert got == expected


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80) | st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "  \n\n x", "it's 12345 ÀÉ", " 　x", "x" * 3000]))
def test_ids_are_those_of_the_library(text):
    exact = Tokenizer.from_file(PATH)
    assert packing.encoder(PATH)(text) == exact.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(path)("Hello World") == Tokenizer.from_file(path).encode("Hello World", add_special_tokens=False).ids


def test_pieces_hold_every_token(spark):
    rng = random.Random(2)
    texts = {k: " ".join(rng.choice(["word", "other", "été", "42", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 80, 3000]))) for k in range(40)}
    rows = [(k, t, "x") for k, t in texts.items()] + [(99, None, "y"), (None, "null id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = packing.pack_documents(df, PATH, block_tokens=6000).collect()
    exact = Tokenizer.from_file(PATH)
    for doc_id, text, _ in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((r.start, r) for r in got if r.doc_id == doc_id)
        assert [i for _, r in own for i in r.ids] == ids.tolist()
        for start, r in own:
            assert r.ids_crc32 == zlib.crc32(ids[start : start + r.length].tobytes()) and r.doc_tokens == len(ids)
    used = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


@pytest.mark.parametrize("rows", [[], [(1, "")]])
def test_small_tables(spark, rows):
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert [(r.doc_id, r.start, r.length, r.ids) for r in got] == [(1, 0, 1, [1])] * len(rows)


@pytest.mark.parametrize("text", ["a" + " " * 5_000_000, "\n" * 5_000_000, "\t" * 1_000_000 + "b", "x" * 300_000, "1" * 300_000, "-" * 300_000, (" " * 70_000 + "y") * 3])
def test_ids_of_very_long_texts(text):
    exact = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert packing.encoder(PATH)(text) == exact


def test_strings_of_special_tokens_as_plain_text():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    text = "a<|endoftext|>b <|endoftext|>"
    assert packing.encoder(PATH, special_as_text=True)(text) == plain.encode(text, add_special_tokens=False).ids
    assert packing.encoder(PATH)(text) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
