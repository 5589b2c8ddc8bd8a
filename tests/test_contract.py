"""Every query of the impact engine against its SQL."""

import pytest

from impactlake.plans import contract

from .oracle import SF, same


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_query_equals_its_sql(spark, name):
    same(spark, contract.QUERIES[name], contract.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert SF
