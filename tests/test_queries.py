"""Every core query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from seqloom.plans import catalogue
from tests.compare import differences, duck

WHERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(WHERE)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, WHERE)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert differences(df, con, sql) == ""


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and catalogue.FLAGSHIP in e.queries()
