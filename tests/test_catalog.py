"""Every named query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from newsloom.catalog import load
from tests.compare import connect, difference

SMALL = "/root/testdata/sf0.001"
QUERIES = {name: build for name, (build, _) in load().items()}
SQL = {name: sql for name, (_, sql) in load().items() if sql is not None}
# Without SQL: worked cases and properties in its own tests.
ROWS_ONLY = {"admit_adaptive"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry_has_all_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).columns == [
        "url", "title", "content", "publisher_name", "published_date", "content_id", "similarity", "bucket",
        "signal_type", "source_type",
    ]


def test_queries_without_the_optional_part(monkeypatch):
    """Whatever cannot be imported there, the library's own queries remain."""
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(QUERIES)


def test_queries_without_a_package_of_the_optional_part():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(entry.__file__))
    assert out.stdout.strip() == str(len(QUERIES)), out.stderr
