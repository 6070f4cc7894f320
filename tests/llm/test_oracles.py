import pytest

from docengine.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])
