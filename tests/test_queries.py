import pytest

from quillgraph.queries import QUERIES, SQL
from tests.oracle import compare, connect

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(QUERIES[name](spark, D), con, SQL[name])


def test_fuzzy_link(spark):
    found = QUERIES["fuzzy_link"](spark, D)
    assert found.where("method = 'fuzzy' and score < 92").count() == 0
    assert found.where("method = 'none' and (score <> 0 or entity is not null)").count() == 0
    assert found.count() == spark.read.parquet(f"{D}/part.parquet").count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
