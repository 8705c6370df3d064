"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestar.operators import search
from lodestar.plans import catalog
from lodestar.plans.base import Tables

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float | int):
        return round(float(value), 6) + 0.0
    return float(value) if type(value).__name__ == "Decimal" else str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    relation = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[k]) for k in order] for r in relation.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["knn_ivf_probe", "knn_ivf_sq8_probe", "knn_graph"])
@pytest.mark.parametrize("folder", [DATA, DATA.parent / "sf0.1"])
def test_recall_of_probing(spark, folder, name):
    """Of the exact ten nearest of every query, at least nine in ten are found."""
    t = Tables(spark, str(folder))
    exact = {(r.qid, r.id) for r in search.knn_exact(t.vectors, t.queries, 10).collect()}
    found = {(r.qid, r.id) for r in catalog.QUERIES[name](spark, str(folder)).collect()}
    recall = len(found & exact) / len(exact)
    print(f"recall {name} {folder.name}: {recall:.3f}")
    assert len(found) == len(exact) and recall >= 0.9


def test_classifier_is_a_fit_of_all_rows(spark):
    rows = catalog.QUERIES["linear_classifier"](spark, str(DATA)).collect()
    assert len(rows) == 65 and all(r.optimal for r in rows) and rows[0].f1 > 0.4


def test_flagship(spark):
    assert catalog.flagship(spark, str(DATA)).count() > 0
