"""Every query of the fact engine against its SQL twin."""

import oracle
import pytest

from factlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        assert oracle.difference(df, con, catalog.ORACLE_SQL[name]) is None
    else:
        assert df.count() >= 0


def test_entry_is_importable():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
