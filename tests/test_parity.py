"""Every query with a SQL twin must return exactly the same values."""

import os

import pytest

import __spark_entry__ as entry
from parity import oracle
from parity.check import compare, connect

FOLDER = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_values(spark, duck, name):
    assert compare(QUERIES[name](spark, FOLDER), duck, calendar_twin(name, duck)) == []


def calendar_twin(name, duck):
    """The twin; that of a pivot with the columns of this folder's calendar."""
    if name == "cohort_triangle_pivot":
        width = duck.execute(oracle.with_relations("SELECT max(month_index) + 1 FROM coh")).fetchone()[0]
        return oracle.with_relations(oracle.triangle_sql(width))
    if name == "issuer_month_heatmap":
        months = duck.execute(oracle.with_relations("SELECT DISTINCT strftime(month, '%Y_%m') FROM bm ORDER BY 1")).fetchall()
        return oracle.with_relations(oracle.heatmap_sql([m for m, in months]))
    return SQL[name]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
