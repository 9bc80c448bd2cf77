"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import pytest
from parity import SF_DIR, assert_same

from convoweave.plans import catalog

WITHOUT_SQL = sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= catalog.QUERIES.keys()
    assert __spark_entry__.entry(spark).count() > 0
