"""Every query of the operators proper against its SQL."""

from __future__ import annotations

import pytest

from loomspark.plans import catalog

from .oracle import of_spark, of_sql


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert of_spark(catalog.QUERIES[name](spark, sf_dir)) == of_sql(catalog.ORACLES[name], sf_dir)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
