import random

import numpy as np
import pytest

from lodestar.llm import language as L

WORDS = {
    "en": "the of and that with this from have which their would there about into could other these some".split(),
    "de": "der die und nicht mit eine auch nach über wird sich haben zwischen für können schon werden größe".split(),
    "el": "και της του που στην για από είναι με τον τους μια αυτό όπως πολύ όταν".split(),
}


def text(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, text(lang, 60, k), lang) for k in range(40) for lang in WORDS] + [(999, "zzz zzz", None), (1000, None, "en")]
    return L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute(scores, penalty):
    best = scores[0].copy()
    for t in range(1, len(scores)):
        best = np.maximum(best, best.max() - penalty[t]) + scores[t]
    return best.max()


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 900])
@pytest.mark.parametrize("k", [1, 2, 5])
def test_viterbi_is_optimal(n, k):
    rng = np.random.default_rng(n * 7 + k)
    scores, penalty = rng.normal(size=(n, k)) * 3, rng.choice([0.0, 5.0], size=n, p=[0.1, 0.9])
    label = L.viterbi(scores, penalty)
    value = scores[np.arange(n), label].sum() - penalty[1:][label[1:] != label[:-1]].sum()
    assert value == pytest.approx(brute(scores, penalty))


def test_held_out_accuracy(model):
    texts = [(lang, text(lang, 25, 1000 + k)) for k in range(30) for lang in WORDS]
    got = L.label_texts(model, [t for _, t in texts])
    assert sum(g["lang"] == lang for g, (lang, _) in zip(got, texts, strict=True)) >= 0.98 * len(texts)
    assert all(0 <= g["score"] <= 1 for g in got)


def test_spans_of_mixed_text(model):
    a, b = text("en", 30, 1), text("de", 50, 2)
    found = L.label_texts(model, [f"{a} 123 {b}"])[0]
    assert found["lang"] == "de"
    assert [s["lang"] for s in found["spans"]] == ["en", "de"]
    assert abs(found["spans"][0]["end"] - len(a)) < 25 and abs(found["spans"][1]["start"] - len(a) - 5) < 25


def test_scripts_narrow_the_candidates(model):
    _, _, names = L._letters()
    greek = model.allowed[names.index("GREEK")]
    assert [g for g, ok in zip(model.langs, greek, strict=True) if ok] == ["el"]
    assert L.label_texts(model, ["ξψζ"])[0]["lang"] == "el"


@pytest.mark.parametrize("bad", [None, "", "123 !? \n", "😀😀"])
def test_undetermined(model, bad):
    assert L.label_texts(model, [bad, "the and", bad])[0] == {"lang": "und", "score": 0.0, "spans": []}


def test_batches_do_not_matter(model, monkeypatch):
    texts = [text("en", 200, 1), None, text("de", 90, 2), "", text("el", 70, 3) + text("en", 10, 4)]
    whole = L.label_texts(model, texts)
    monkeypatch.setattr(L, "CHUNK", 100)
    assert L.label_texts(model, texts) == whole


def test_column(spark, model):
    df = spark.createDataFrame([(1, text("de", 9, 1), "clash"), (2, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(df, model).collect()}
    assert got[1].language.lang == "de" and got[1].lang == "clash" and got[2].language.lang == "und"
    assert L.identify(df.limit(0), model).count() == 0


def test_without_labels(spark):
    model = L.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert L.label_texts(model, ["some text"])[0]["lang"] == "und"


def test_query_without_doc_ids(spark, tmp_path):
    """A row without doc_id is not held out, and is labelled like others."""
    from lodestar.llm import queries

    rows = [(k, text(lang, 30, k), lang) for k in range(20) for lang in WORDS] + [(None, text("el", 30, 99), None), (None, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [r for r in queries.op8_language_spans(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert sorted((r.held_out, r.lang_pred) for r in got) == [(False, "el"), (False, "und")]


def test_a_column_of_that_name_stays(spark):
    docs = spark.createDataFrame([(k, t, l, "mine") for k, (t, l) in enumerate([("the house of the king", "en"), ("das Haus der Katze", "de")] * 5)], "doc_id long, text string, lang string, language string")
    got = L.identify(docs, L.learn(docs))
    assert got.columns == [*docs.columns, "language_2"]
    assert {(r.language, r.language_2.lang == r.lang) for r in got.collect()} == {("mine", True)}


def test_too_many_languages(spark):
    rows = spark.range(L.MOST_LANGUAGES + 1).selectExpr("id as doc_id", "'some words' as text", "concat('l', id) as lang")
    with pytest.raises(ValueError, match="languages"):
        L.learn(rows)
