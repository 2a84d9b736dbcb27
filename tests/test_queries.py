"""Every registered query that SQL can express equals its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

import check_queries  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", list(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    problem, _, _ = check_queries.compare(spark, duck, name, FOLDER)
    assert not problem


def test_entry(spark):
    assert spark_entry.entry(spark).count() == 169


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())
