"""Every named query against its SQL on the smallest tables."""

import pytest

from tests.compare import compare
from vacancyledger.plans import catalog

SF_DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, SF_DIR, name) is None
