"""The registered text queries against their SQL, on the driver's smallest tables."""

import pytest
from compare import duck, sf_dir, spark_rows, sql_rows

from storeloom.llm.queries import REGISTRY

SF = "0.001"
# Rows of queries without SQL that do not answer each of the 200 documents.
ROWS = {"op12_embedding_whitening": 2000, "op13_conversation_repair": 100}


@pytest.fixture(scope="module")
def con():
    return duck(sf_dir(SF))


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_its_sql(spark, con, name):
    q = REGISTRY[name]
    columns, got = spark_rows(q.run(spark, sf_dir(SF)))
    if q.oracle is None:
        assert sum(got.values()) == ROWS.get(name, 200)
        return
    want_columns, want = sql_rows(con, q.oracle)
    assert columns == want_columns
    assert got == want


def test_all_are_registered():
    import __spark_entry__ as e

    found = {n.split("_")[0] for n in e.queries() if n.startswith("op") and n[2].isdigit()}
    assert found == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in e.queries()
