"""Queries with a SQL twin against it."""

import pytest

from checks import compare as checks
from hostlens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name, monkeypatch):
    monkeypatch.setitem(checks.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(checks.ORACLES, name, ORACLES[name])
    result = checks.compare(spark, checks.oracle_connection(FOLDER), name, FOLDER)
    assert result.startswith("ok") and "types" not in result, result
