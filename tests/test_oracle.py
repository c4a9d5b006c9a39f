"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from labtrail.plans import catalog
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("key", sorted(catalog.QUERIES))
def test_query(spark, con, key):
    message, rows, _ = compare(
        spark, con, FOLDER, key, catalog.QUERIES[key], catalog.ORACLES.get(key)
    )
    assert message is None, message
    assert rows >= 0


def test_entry(spark):
    import __spark_entry__ as entry_module

    frame = entry_module.entry(spark)
    assert frame.count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
