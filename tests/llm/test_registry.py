import pytest
from oracle import SF, canonical, database

from meridia.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(database().sql(ORACLES[name]).df())


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
