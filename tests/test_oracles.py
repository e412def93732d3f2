"""Every registered query against its oracle SQL on the smallest tables."""

import os

import pytest
from compare import compare, oracle_connection

from fieldlens import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query_matches_oracle(spark, oracle, name):
    status, _, _, note = compare(spark, oracle, name, SF)
    assert status in ("ok", "rows-only"), note
    assert "TYPES" not in note
