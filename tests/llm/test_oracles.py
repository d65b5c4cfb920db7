import pytest
from oracle import same

from sparkhound.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    same(spark, "/root/testdata/sf0.001", QUERIES[name], ORACLES[name])
