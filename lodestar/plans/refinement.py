"""Queries of refinement: probe, classifier, quality scorer, on all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.vectors import affine, l2_normalize
from lodestar.operators import refine
from lodestar.plans.base import query


def labelled(t):
    return t.vectors.select("id", "vector", (F.col("label") < 3).alias("label"))


def probe(t):
    """The probe's vector and bias, and the largest component of the loss's gradient there."""
    w, b = refine.linear_probe(t.queries.select("vector"), labelled(t))
    anchor = refine.anchor_max(t.queries.select("vector"))
    both = labelled(t).crossJoin(F.broadcast(anchor))
    p = 1 / (1 + F.exp(-affine(F.col("vector"), w.tolist(), b)))
    slope = both.select((p - F.col("label").cast("double")).alias("d"), F.posexplode("vector").alias("place", "x"), "anchor")
    places = slope.groupBy("place").agg(F.avg(F.col("d") * F.col("x")).alias("g"), F.first(F.col("anchor")[F.col("place")]).alias("a"))
    known = F.element_at(F.array(*[F.lit(float(v)) for v in w]), F.col("place") + 1)
    return places.select(F.col("place").cast("long").alias("place"), (F.abs(F.col("g") + 2 * refine.PENALTY * (known - F.col("a"))) < 1e-5).alias("optimal"))


query("linear_probe", probe, "SELECT range AS place, true AS optimal FROM range(0, (SELECT max(len(embedding)) FROM embeddings))")


def classified(t):
    """The classifier on all rows: per place of its vector whether the penalised loss is flat there, the chosen inverse
    penalty, and its F1 on the rows."""
    rows = labelled(t)
    w, b, c = refine.linear_classifier(rows)
    n = rows.agg(F.count("*").alias("n"), F.count_if("label").alias("positives")).first()
    weight = F.when(F.col("label"), n.n / (2 * n.positives)).otherwise(n.n / (2 * (n.n - n.positives)))
    p = 1 / (1 + F.exp(-affine(F.col("vector"), w.tolist(), b)))
    slope = rows.select((weight * (p - F.col("label").cast("double"))).alias("d"), F.posexplode(F.concat(F.transform("vector", lambda x: x.cast("double")), F.array(F.lit(1.0)))).alias("place", "x"))
    places = slope.groupBy("place").agg(F.sum(F.col("d") * F.col("x")).alias("g"))
    pulls = F.element_at(F.array(*[F.lit(float(v)) for v in w], F.lit(0.0)), F.col("place") + 1) / c
    quality = refine.f1_positive(rows.select("label", (affine(F.col("vector"), w.tolist(), b) > 0).alias("said")))
    return places.crossJoin(quality.select(F.round("f1", 6).alias("f1"))).select(F.col("place").cast("long").alias("place"), (F.abs(F.col("g") + pulls) < 1e-3 * n.n).alias("optimal"), F.lit(c).alias("c"), "f1")


query("linear_classifier", classified)


def scorer(t):
    """The scorer on all rows: per place of the unit vector (the last one: the constant) whether least squares is flat there."""
    rows = t.vectors.select("vector", (F.col("label") + 0.0).alias("label"))
    coef, intercept = refine.fit_quality_scorer(rows)
    unit = F.concat(l2_normalize(F.col("vector"), 1e-6), F.array(F.lit(1.0)))
    off = refine.quality_score(F.col("vector"), coef, intercept) - F.col("label") / 10
    slope = rows.select(off.alias("d"), F.posexplode(unit).alias("place", "x")).groupBy("place").agg(F.avg(F.col("d") * F.col("x")).alias("g"))
    return slope.select(F.col("place").cast("long").alias("place"), (F.abs("g") < 1e-6).alias("optimal"))


query("fit_quality_scorer", scorer, "SELECT range AS place, true AS optimal FROM range(0, 1 + (SELECT max(len(embedding)) FROM embeddings))")
