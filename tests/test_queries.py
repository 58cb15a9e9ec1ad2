"""Every registered query equals its SQL on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

import __spark_entry__ as entry  # noqa: E402
from check_queries import alike, canonical, connect  # noqa: E402

from riskloom.plans.oracles import oracle_sql  # noqa: E402
from riskloom.plans.queries import QUERIES  # noqa: E402

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    con = connect(small)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    assert all(alike(kinds[c[0]], str(c[1])) for c in result.description)
    assert canonical(df.collect(), df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0
