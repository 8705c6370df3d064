"""Load and search of generated vectors: rows, width and queries from the command line; prints JSON lines, the last of which has all.

    python bench_vectors.py 1000000 256 200

Half of the rows lie around centres, about 100 around each (cells help there), the others have no structure. Recall is of the exact ten
nearest by cosine. Times are of one run each, without the generation of the rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import hash_id
from lodestar.functions.vectors import l2_normalize
from lodestar.operators import coded, graph, pruned, search
from lodestar.operators.embedding import gaussian_vector
from lodestar.session import ship

#: Of the clustered half: rows of a centre, and the share of their own values.
PER_CENTRE, NOISE = 100, 0.5
#: Rows up to which the graph is built here: a round shuffles about 20 vectors a row.
MOST_GRAPH = 100_000


def main() -> None:
    rows, width, queries = map(int, sys.argv[1:4]) if len(sys.argv) > 3 else (1_000_000, 256, 200)
    cells = max(16, int(rows**0.5) // 2)
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', 8)}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", f"{scratch}/local")
        .config("spark.checkpoint.dir", f"{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    found: dict = {"rows": rows, "width": width, "queries": queries, "cells": cells}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        found[name] = round(time.perf_counter() - began, 2)

    own, centre = gaussian_vector(F.col("id"), width), gaussian_vector(F.pmod(F.xxhash64("id"), F.lit(max(16, rows // (2 * PER_CENTRE)))), width, 1)
    near = F.zip_with(own, centre, lambda x, c: x * NOISE + c)
    raw = spark.range(0, rows, 1, 64).select("id", F.when(F.col("id") % 2 == 0, near).otherwise(own).cast("array<float>").alias("vector"))
    raw.write.parquet(f"{scratch}/raw")
    stored = spark.read.parquet(f"{scratch}/raw")
    unit = stored.select("id", hash_id([F.col("id"), F.lit("v")]).alias("key"), l2_normalize(F.col("vector")).cast("array<float>").alias("vector"))
    timed("load_s", lambda: unit.write.parquet(f"{scratch}/loaded"))
    found["vectors_per_second_loaded"] = round(rows / found["load_s"])
    docs = spark.read.parquet(f"{scratch}/loaded").select("id", "vector")
    asked = docs.where(F.col("id") % (2 * rows // queries) < 2).select(F.col("id").alias("qid"), "vector")
    asked.write.parquet(f"{scratch}/queries")
    asked = spark.read.parquet(f"{scratch}/queries")
    hits: dict = {}

    def keep(name: str, df) -> None:
        hits[name] = {(r.qid, r.id) for r in df.collect()}

    timed("exact_s", lambda: keep("exact", search.knn_exact(docs, asked, 10, "cosine")))
    found["exact_searches_per_second"] = round(queries / found["exact_s"], 2)
    centres = search.train_cells(docs, cells)
    timed("index_s", lambda: search.build_ivf(docs, centres).write.parquet(f"{scratch}/index"))
    index = spark.read.parquet(f"{scratch}/index")
    for probes in (1, 8, 32, cells // 4, cells // 2):
        timed(f"probes_{probes}_s", lambda p=probes: keep("found", search.search_ivf(index, asked, centres, 10, p, "cosine")))
        for name, odd in (("clustered", 0), ("isotropic", 1)):
            exact = {h for h in hits["exact"] if h[0] % 2 == odd}
            if exact:
                found[f"recall_{name}_{probes}"] = round(len(exact & hits["found"]) / len(exact), 3)
    print(json.dumps(found), flush=True)

    def recall(name: str) -> None:
        for kind, odd in (("clustered", 0), ("isotropic", 1)):
            exact = {h for h in hits["exact"] if h[0] % 2 == odd}
            found[f"recall_{kind}_{name}"] = round(len(exact & hits["found"]) / max(1, len(exact)), 3)

    timed("coded_index_s", lambda: coded.build_coded_cells(docs, centres).write.partitionBy("cell").parquet(f"{scratch}/coded"))
    codes = spark.read.parquet(f"{scratch}/coded").withColumn("cell", F.col("cell").cast("long"))
    for probes in (8, cells // 10):
        timed(f"coded_{probes}_s", lambda p=probes: keep("found", coded.search_coded_cells(codes, asked, centres, 10, p, "cosine")))
        recall(f"coded_{probes}")
    print(json.dumps(found), flush=True)
    timed("balls_s", lambda: pruned.build_balls(docs, centres, "cosine").write.parquet(f"{scratch}/balls"))
    balls = spark.read.parquet(f"{scratch}/balls")
    near = asked.where("qid % 2 = 0")
    timed("pruned_s", lambda: keep("found", pruned.knn_pruned(balls, near, 10, "cosine")))
    recall("pruned")
    found["pairs_met"] = round(pruned.pairs_met(balls, near, 10, "cosine").count() / max(1, balls.count() * near.count()), 4)
    print(json.dumps(found), flush=True)
    if rows <= MOST_GRAPH:
        timed("graph_s", lambda: found.update(changes=build(docs, f"{scratch}/graph")))
        linked = spark.read.parquet(f"{scratch}/graph")
        timed("graph_search_s", lambda: found.update(rounds=follow(linked, asked, keep)))
        recall("graph")
    print(json.dumps(found), flush=True)
    spark.stop()


def build(docs, path: str) -> list[float]:
    graph_, changes = graph.build_graph(docs)
    graph_.write.parquet(path)
    return changes


def follow(linked, asked, keep) -> int:
    hits, rounds = graph.search_graph(linked, asked, 10)
    keep("found", hits)
    return rounds


if __name__ == "__main__":
    main()
