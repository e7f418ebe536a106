import pytest

import __spark_entry__ as entry
from foliant.queries import QUERIES, SQL, retrieval
from tests.compare import assert_same, tables


@pytest.fixture(scope="module")
def duck(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert_same(QUERIES[name](spark, sf), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_all_postings_add_up_to_lengths(spark, sf):
    rows = QUERIES["term_frequency"](spark, sf)
    lengths = retrieval.lexical.build(retrieval.chunks(spark, sf)).docs
    assert rows.where("tf = 1").count() > 0 and rows.groupBy().sum("tf").first()[0] == lengths.groupBy().sum("dl").first()[0]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "score", "rank"] and df.count() == 150


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
