"""Every registered query of the engine's own operators against its SQL."""

from __future__ import annotations

import pytest

from tests.oracle import assert_same, duck
from vantidal import catalog, catalog_records, catalog_rules, catalog_sql


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf, con, name):
    assert_same(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])


def test_all_are_registered():
    import __spark_entry__

    assert catalog_sql.E and catalog_rules.TOOLS and catalog_records.CUSTOMERS and set(catalog.SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
