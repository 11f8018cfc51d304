"""Every query with SQL gives the same rows as DuckDB, the others run; over the smallest tables, whole."""

import pytest
from conftest import DATA
from oracle import multiset, views

import __spark_entry__ as entry
from stelwerk.queries import graph_queries, problems

SQL = problems.SQL | graph_queries.SQL
QUERIES = problems.QUERIES | graph_queries.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = views(DATA).sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert multiset(got) == multiset(want)


#: Queries over citation forms that the smallest tables don't hold.
EMPTY = {"link_eu", "link_judgments", "link_parliament"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_the_same_rows_each_time(spark, name):
    first, again = (QUERIES[name](spark, DATA).toPandas() for _ in range(2))
    assert multiset(first) == multiset(again)
    assert bool(len(first)) == (name not in EMPTY)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (2, 3, 5, 6)} <= set(entry.queries())
