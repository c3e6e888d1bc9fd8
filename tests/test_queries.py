"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import pytest
from helpers import DATA, same_rows

from pivotlake.plans import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    if name in ORACLES:
        same_rows(found, ORACLES[name], duck)
    else:
        assert found.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 50
