import pytest
from oracle import SF, canonical, database

import __spark_entry__
from meridia.plans import build_queries, mapped_queries, point_queries, raster_queries, row_queries, shape_queries, topology_queries, unit_queries

PLANS = (point_queries, raster_queries, shape_queries, build_queries, mapped_queries, row_queries, topology_queries, unit_queries)
ORACLES = {k: v for p in PLANS for k, v in p.ORACLES.items()}
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(db.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["point_id", "city_id", "distance_km"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nearest_city_shuffles_no_text_and_no_cross_product(spark):
    plan = QUERIES["nearest_city"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
