import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodestar.llm import packing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(1)
    stems = {"en": "the of and that with this from have which".split(), "de": "der die und nicht mit eine auch nach wird".split()}
    rows = []
    for k in range(90):
        lang = rng.choice(["en", "en", "de"])
        words = [rng.choice(stems[lang]) + rng.choice(["", "s", "en", "ly"]) for _ in range(rng.randint(30, 90))]
        rows.append([k, " ".join(words), lang, f"src{rng.choice([0, 0, 1, 2])}", 0])
    rows.append([100, rows[0][1], "en", "src1", 0])
    rows.append([101, rows[3][1] + " one more word", "en", "src1", 0])
    rows.append([102, "12345 !!", "en", "src0", 0])
    rows.append([103, None, "en", "src0", 0])
    rows[5][1] += " password=abcdef0123456789zz and more"
    rows[6][2] = None
    return [(*r[:4], len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_language(spark, docs):
    got = {r.doc_id: r for r in P.keep_languages(spark, docs, "").collect()}
    assert set(got) == {r[0] for r in corpus()} - {102, 103}
    assert got[6].lang in ("en", "de")


def test_near_duplicates(spark, docs):
    kept = {r.doc_id for r in P.keep_representatives(spark, docs, "").collect()}
    assert kept == {r[0] for r in corpus()} - {100, 101}
    twice = docs.unionByName(docs.where("doc_id = 7"))
    assert P.keep_representatives(spark, twice, "").where("doc_id = 7").count() == 1


def test_secrets(spark, docs):
    got = {r.doc_id: r for r in P.hide_secrets(spark, docs, "").collect()}
    assert len(got) == len(corpus())
    assert "[SECRET] and more" in got[5].text and got[5].n_chars == len(got[5].text)
    assert all(got[r[0]].text == r[1] for r in corpus() if r[0] != 5)
    digest = "0641917ea4e9feb9cda83477b57ac2654884f485"
    one = spark.createDataFrame([(1, f"sum {digest} x", "en", "s", 1)], SCHEMA)
    assert digest in P.hide_secrets(spark, one, "").first().text


def test_mixture(spark, docs):
    kept = P.keep_mixture(spark, docs, "")
    n = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert 0.88 <= n(kept) / n(docs) <= 0.95
    assert kept.columns == docs.columns


def test_packing_and_columns(spark, docs):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.selectExpr("*", "1 as _n", "'x' as component_id"), "").columns == [*docs.columns, "_n", "component_id"]
    got = P.pack(spark, docs, "").collect()
    encode = packing.encoder(queries.tokenizer("byte_bpe_50k.json"))
    assert sum(r.length for r in got) == sum(len(encode(r[1] or "")) + 1 for r in corpus())


def test_run_on_a_folder(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got}.isdisjoint({100, 101, 102, 103})


def test_empty_table(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_rows_of_one_id_are_kept_by_their_own_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, a, "en"), (5, a + " more", "en"), (5, b, "en"), (5, b + " more", "de"), (7, None, "en"), (7, None, "en"), (None, a, "en"), (None, a, "en"), (8, "c d", "en"), (8, "c d", "de"), (9, "", "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = P.keep_representatives(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    fixed = [(1, a), (7, None), (7, None), (None, a), (None, a), (8, "c d"), (9, ""), (9, "")]
    assert got in (sorted([*fixed, (5, x)], key=str) for x in (b, b + " more"))


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_of_each_group_stays(spark, seed):
    """Against all pairs, with repeated ids, equal rows, and null, blank and equal texts among them."""
    rng = random.Random(seed)
    stems = [[rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(40)] for _ in range(12)]
    rows = []
    for k in range(120):
        words = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(40)] = "z" + str(rng.randint(0, 99))
        rows.append((rng.choice([k, 1000 + k // 4]), rng.choice([" ".join(words), " ".join(words), " ".join(words), None, " "])))
    rows += rows[:20]
    sets = [frozenset(tuple((t or "").split()[i : i + 5]) for i in range(36)) if (t or "").split() else frozenset() for _, t in rows]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 4 * len(x & sets[j]) >= 3 * len(x | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    kept = P.keep_representatives(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    smallest = {}
    for (d, _), g in zip(rows, group, strict=True):
        smallest[g] = min(d, smallest.get(g, d))
    assert sorted(r.doc_id for r in kept) == sorted(smallest.values())
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)


def test_columns_with_the_names_of_helpers(spark, docs):
    own = {"_language": "'mine'", "text_hash": "7L", "_row": "'r'", "spans": "'s'", "language": "'l'", "key": "'k'", "domain": "'d'", "tokens": "'t'", "Count": "'c'", "first": "'f'"}
    clashing = docs.selectExpr("*", *(f"{v} as {c}" for c, v in own.items()))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, clashing, "")
        assert got.columns == clashing.columns
        assert {tuple(r[c] for c in own) for r in got.collect()} == {("mine", 7, "r", "s", "l", "k", "d", "t", "c", "f")}
    assert P.pack(spark, clashing, "").count() == P.pack(spark, docs, "").count()


@pytest.mark.parametrize("ids", ["null", "5", "id", "id div 40"])
def test_mixture_takes_rows_one_by_one(spark, ids):
    """Rows of equal length: nine in ten stay, also without a doc_id, with one for all, or with few."""
    rows = spark.range(200).selectExpr(f"cast({ids} as long) as doc_id", "'one two three' as text", "'en' as lang", "'src1' as source", "13L as n_chars")
    assert P.keep_mixture(spark, rows, "").count() == 180
    named = rows.withColumn("text", F.concat(F.lit("one two "), F.monotonically_increasing_id()))
    kept = [r.text for r in P.keep_mixture(spark, named, "").collect()]
    assert len(set(kept)) == len(kept) == 180


def test_packing_of_long_white_space(spark):
    texts = ["a" + " " * 1_000_000, "\n" * 1_000_000 + "b", "x" + "\t" * 1_000_000]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], SCHEMA)
    got = P.pack(spark, docs, "").collect()
    exact = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    assert {r.doc_id: r.doc_tokens for r in got} == {k: len(exact.encode(t, add_special_tokens=False).ids) + 1 for k, t in enumerate(texts)}
