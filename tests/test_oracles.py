import pytest

from tests.oracle import compare
from wavemill.jobs import bleed_queries, filter_queries, queries

MODULES = (queries, filter_queries, bleed_queries)
QUERIES, ORACLES = ({k: v for m in MODULES for k, v in getattr(m, kind).items()} for kind in ("QUERIES", "ORACLES"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert compare(spark, QUERIES[name], ORACLES[name], sf_dir) > 0
