import hashlib
import random

import numpy as np
import pytest

from lodestar.llm import fingerprint as P


def test_equal_and_edited_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefgh é") for _ in range(n)) for n in (0, 1, 7, 400, 5000)]
    s = P.sketches(texts)
    assert (s == P.sketches(texts)).all()
    assert (s[3] == P.sketches([texts[3]])[0]).all()
    assert P.likeness_of(s, s).tolist() == [1.0] * 5
    edited = texts[4][:3750] + "".join(rng.choice("xyz") for _ in range(1250))
    assert 0.4 < P.likeness_of(s[4:], P.sketches([edited]))[0] < 0.8
    assert P.likeness_of(s[3:4], s[4:])[0] < 0.1


def test_phrases_do_not_depend_on_offset():
    rng = random.Random(2)
    inner = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    shifted = ["".join(rng.choice("klmnop") for _ in range(k)) + inner for k in (0, 1, 5, 13)]
    s = P.sketches(shifted)
    assert (P.likeness_of(np.repeat(s[:1], 3, axis=0), s[1:]) > 0.85).all()


def test_runs():
    a, b = P.sketches(["a" * 100_000, "a" * 100_001])
    assert (a != b).any()
    assert (P.sketches(["ab" * 5000]) == P.sketches(["ab" * 5000])).all()


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int, block string")
    return P.compare_with_edits(df).collect()


@pytest.mark.parametrize("n", [1, 2, 57])
def test_compare_with_edits(spark, n):
    rng = random.Random(n)
    rows = [(7 * k - 20, "".join(rng.choice("abé😀 d") for _ in range(rng.choice([0, 1, 3, 50, 900]))), 1, "x") for k in range(n)]
    rows[-1] = (rows[-1][0], None, None, None)
    rng.shuffle(rows)
    got = {r.doc_id: r for r in rows_of(spark, rows)}
    order = sorted((d, t or "") for d, t, _, _ in rows)
    assert len(got) == n
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[doc_id]
        a, b, c = P.sketches([text, edited, after])
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(P.to_text(np.array([a, b])))
        assert (r.near_edited, r.near_next) == (P.likeness_of(a[None], b[None])[0], P.likeness_of(a[None], c[None])[0])


def test_edges(spark):
    assert rows_of(spark, []) == []
    got = rows_of(spark, [(None, "abc", 1, ""), (1, "abcd", 1, ""), (1, "abce", 1, "")])
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 4), (False, 4), (True, 3)]


def test_columns_of_fingerprints(spark):
    df = spark.createDataFrame([("some text of words", "some text of words"), (None, "")], "a string, b string")
    out = df.select(P.likeness(P.fingerprint("a"), P.fingerprint("b")).alias("x")).collect()
    assert [r.x for r in out] == [1.0, 1.0]
