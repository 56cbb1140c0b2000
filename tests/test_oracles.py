"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import duck, sf_dir, spark_rows, sql_rows

from storeloom.plans.all_queries import REGISTRY

SF = "0.001"


@pytest.fixture(scope="module")
def con():
    return duck(sf_dir(SF))


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    q = REGISTRY[name]
    columns, got = spark_rows(q.run(spark, sf_dir(SF)))
    if q.oracle is None:
        assert got
        return
    want_columns, want = sql_rows(con, q.oracle)
    assert columns == want_columns
    assert got == want


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(REGISTRY) - set(e.oracle_sql()) == {"knn_lsh"}
