import pytest
from conftest import DATA
from oracle import multiset, views

from stelwerk.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), views(DATA).sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and multiset(got) == multiset(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_the_same_rows_each_time(spark, name):
    first, again = (queries.QUERIES[name](spark, DATA).toPandas() for _ in range(2))
    assert len(first) and multiset(first) == multiset(again)


def test_columns():
    import __spark_entry__ as entry

    assert {f"p{n}_found" for n in (1, 4, 8, 9)} <= set(entry.queries())
