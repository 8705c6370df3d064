import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.llm import mixture


def fill(budget, children):
    """Water-filling of (name, weight, capacity) children, one token of rounding at most apart from exact shares."""
    out, rest = {}, list(children)
    while rest:
        total = sum(w for _, w, _ in rest)
        full = [c for c in rest if total and c[2] * total <= c[1] * budget]
        if not full:
            return out | {n: (w * budget / total if total else 0.0) for n, w, _ in rest}
        for n, _, c in full:
            out[n] = float(c)
            budget -= c
        rest = [c for c in rest if c not in full]
    return out


def tables(spark, seed=3, n=300):
    rng = random.Random(seed)
    rows = [(k, " ".join("w" * rng.randint(1, 40)), rng.choice(["en", "en", "de", None]), rng.choice(["s0", "s0", "s0", "s1", "s2"]), k) for k in range(n)]
    rows += [(n, None, "en", "s1", 0), (n + 1, "", "en", "s1", 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens long")


LEVELS = ("lang", "source")


def levels():
    return {name: F.col(name) for name in LEVELS}


@pytest.mark.parametrize(("share", "epochs"), [(0.5, 1), (1.0, 3), (2.5, 2), (0.0, 2)])
def test_budgets_and_prefixes(spark, share, epochs):
    rows, df = tables(spark)
    weights = {"lang": F.when(F.col("lang") == "en", 1).otherwise(4), "source": F.when(F.col("source") == "s0", 1).otherwise(3)}
    mixed = mixture.mix(df, levels(), weights, F.floor(F.col("tokens") * share), epochs, seed=5)
    tokens = defaultdict(int)
    for _, text, lang, source, _ in rows:
        tokens[lang, source] += len((text or "").split())
    total = min(int(sum(tokens.values()) * share), epochs * sum(tokens.values()))
    langs = {lang for lang, _ in tokens}
    up = fill(total, [(g, 1 if g == "en" else 4, epochs * sum(t for (h, _), t in tokens.items() if h == g)) for g in langs])
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.lang, r.source] += r.epochs * r.tokens + (r.taken or 0)
    assert sum(got.values()) == total
    for g in langs:
        want = fill(up[g], [(s, 1 if s == "s0" else 3, epochs * t) for (h, s), t in tokens.items() if h == g])
        for s, w in want.items():
            assert abs(got[g, s] - w) <= 3, (g, s)


def test_prefix_follows_the_seeded_order(spark):
    rows, df = tables(spark)
    one = mixture.mix(df.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), levels(), {}, F.floor(F.col("tokens") * 0.4), 1, seed=9)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"9:1:{r[0]}".encode()).hexdigest(), r[0]))
    limit, at, want = int(sum(len((r[1] or "").split()) for r in rows) * 0.4), 0, {}
    for doc_id, text, *_ in order:
        n = len((text or "").split())
        if at < limit:
            want[doc_id] = min(n, limit - at)
        at += n
    got = {r.doc_id: r.taken for r in one.collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_partitions_do_not_matter_and_plan_is_native(spark):
    _, df = tables(spark)
    a = mixture.epochs_of(mixture.mix(df, levels(), {}, F.col("tokens") * 2, 3))
    b = mixture.epochs_of(mixture.mix(df.repartition(7), levels(), {}, F.col("tokens") * 2, 3))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    _, df = tables(spark)
    assert mixture.mix(df.limit(0), levels(), {}, F.col("tokens"), 2).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", None, None)], "doc_id long, text string, lang string, source string")
    got = mixture.mix(df, levels(), {}, F.col("tokens"), 1).collect()
    assert sorted(r.tokens * r.epochs + (r.taken or 0) for r in got) == [1, 2, 2]
