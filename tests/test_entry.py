"""Every registered engine query against DuckDB on the smallest tables."""

import pytest
from oracle import same, tables

import __spark_entry__ as entry
from corvane import queries as engine


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(engine.EVERY))
def test_oracle(spark, sf, con, name):
    query, sql = engine.EVERY[name]
    same(query(spark, sf), con, sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "d"] and df.count() == 10


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(engine.EVERY) <= set(entry.queries())


def test_no_module_imports_the_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(engine.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
