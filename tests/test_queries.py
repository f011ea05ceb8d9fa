"""Every registered query of the factor library against its SQL."""

import math

import pytest

from panelwright.plans import catalogue

from .oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_values_without_sql(spark, name):
    """Rows there are, numbers are finite, and shares and probabilities lie between 0 and 1."""
    rows = [r.asDict() for r in catalogue.QUERIES[name](spark, SF).collect()]
    assert rows and any(v is not None for r in rows for v in r.values())
    for r in rows:
        for column, v in r.items():
            assert not isinstance(v, float) or math.isfinite(v), (name, column)
            if v is not None and column in ("psr", "dsr", "r2", "r_squared"):
                assert 0 <= v <= 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
