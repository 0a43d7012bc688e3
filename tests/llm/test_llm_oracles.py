"""The queries that SQL can express, against DuckDB."""

import pytest
from oracle import assert_equal, connect

from fluvia.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert_equal(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLES[name])
