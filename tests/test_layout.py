import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_only_the_entry_point_imports_the_training_data_operators():
    for source in ROOT.glob("lodestar/**/*.py"):
        if "llm" not in source.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) lodestar\.llm", source.read_text(), re.M), source


def test_queries_and_their_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) > 180
