import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from keyloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return connection


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_registered():
    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    found = catalogue.QUERIES[name](spark, sf).toPandas()
    assert len(found.columns)
    if name in catalogue.SQL:
        wanted = duck.execute(catalogue.SQL[name]).df()
        columns = sorted(found.columns)
        assert columns == sorted(wanted.columns)
        plain = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
        assert plain(found) == plain(wanted)


def test_the_rest_works_without_the_text_operators(tmp_path):
    """A copy without their folders still imports and lists the engine's queries."""
    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "keyloom"), tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
