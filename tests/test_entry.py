"""Entry points and every registered query beside its SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver
from catalog.registry import ALL_QUERIES
from check import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry_points(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_core_queries_stay_when_the_optional_part_cannot_be_imported():
    """In a process of its own: the tokenizer files' package is blocked, and so is a module of the part."""
    for blocked in ("public_tokenizers", "ratewright.llm.queries", "corpus_pipeline"):
        code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; from catalog.registry import ALL_QUERIES as q; assert set(e.queries()) == set(q)"
        subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], check=True, cwd=Path(driver.__file__).parent)


@pytest.mark.parametrize("name", list(ALL_QUERIES))
def test_query_equals_its_sql(spark, con, sf, plan, name):
    run, sql = ALL_QUERIES[name]
    df = run(spark, sf)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    rows, _, problem = compare(spark, con, sf, lambda *_: df, sql)
    assert problem is None
    assert rows > 0
