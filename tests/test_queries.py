"""Every query of the catalog against its SQL oracle, on the smallest tables."""

import pytest

from shoebox import plans
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    found = plans.QUERIES[name](spark, SMALL).toPandas()
    if name in plans.ORACLE:
        assert same_rows(found, duck.execute(plans.ORACLE[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
