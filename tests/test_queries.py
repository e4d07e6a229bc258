"""Every registered query of the core against its SQL; queries without SQL must run with a stable schema."""

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from veridiff.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, db, name):
    assert rows_of(QUERIES[name](spark, data)) == rows_of_sql(db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_corpus_operators(tmp_path):
    """The entry module must work where the corpus subpackage and the pipeline are absent."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/veridiff", tmp_path / "veridiff", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'table_exact' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
