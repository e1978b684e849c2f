"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from checks.compare import compare, oracle_connection
from checks.queries import ORACLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    result = compare(spark, con, name, FOLDER)
    assert result.startswith("ok") and "types" not in result, result
