"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

from locusframe.catalog import all_oracles, all_queries
from oracle_check import compare, duck

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_registry_is_complete():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    count, problem = compare(spark, con, name, all_queries()[name], all_oracles()[name], SF_DIR)
    assert problem is None
    assert count > 0
