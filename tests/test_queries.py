import pytest

from gatewarden.oracles import ORACLES
from gatewarden.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, check_same, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        check_same(df, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
