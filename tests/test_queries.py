"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(k for k in entry.oracle_sql())


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(names), sorted(tuple(show(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = con.execute(entry.oracle_sql()[name])
    assert got == rows([d[0] for d in c.description], c.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_session_is_needed_to_list_queries():
    import subprocess
    import sys

    top = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=top, check=True)
