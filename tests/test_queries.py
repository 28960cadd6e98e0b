"""Every query of the engine against its SQL, on the smallest tables."""

import pytest

from tests.oracle import assert_same, connect
from verisift.jobs.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, con, ORACLES[name])
    else:
        df.collect()


def test_entry_is_importable_and_complete(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
