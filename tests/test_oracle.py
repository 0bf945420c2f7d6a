"""Every registered query against its oracle SQL on the sample tables."""

import pytest

import __spark_entry__ as entry
from checks.catalog import CHECKS
from checks.compare import connect, differences
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(CHECKS))
def test_matches_oracle(spark, con, name):
    found = differences(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert not found, "\n".join(found)


def test_flagship_is_not_empty(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert all(sql for _, sql in CHECKS.values())
    assert set(CHECKS) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


TELLING = ["trickle_hours", "trickle_summary", "trickle_top_queries", "top_jobs_of_category", "storage_recommendations"]


@pytest.mark.parametrize("name", TELLING)
def test_sample_data_reaches_the_filters(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0
