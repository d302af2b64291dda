import pytest

import __spark_entry__ as entry
from tests.check_oracles import compare, connect

from trendloom.plans.oracles import oracles
from trendloom.plans.queries import QUERIES

SQL = oracles()
ROWS_ONLY = {
    "svd_singular_values",
    "svd_whiten",
    "explained_variance",
    "kmeans_scout",
    "kmeans_sweep",
    "kmeans_final",
    "topic_map_2d",
    "topic_map_refined",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_is_iterative():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, db, name):
    assert compare(QUERIES[name](spark, sf_dir), db.sql(SQL[name])) == []


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"cluster", "label", "update_year", "share"} <= set(rows[0].asDict())
