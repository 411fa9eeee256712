"""Every registered query against its SQL at the smallest scale."""

from __future__ import annotations

import pytest

from frameloom.plans import catalog
from tests.comparing import same_rows

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    same_rows(catalog.queries()[name](spark, sf), ORACLES[name], sf)


def test_queries_without_sql_run(spark, sf):
    for name in sorted(set(catalog.queries()) - set(ORACLES)):
        assert catalog.queries()[name](spark, sf).count() > 0, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
