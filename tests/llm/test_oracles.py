import pytest

from tests.oracle import compare
from wavemill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, QUERIES[name], ORACLES[name], sf_dir) > 0
