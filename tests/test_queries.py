"""Every registered query equals its SQL on the smallest tables."""

import pytest

from checks.compare import compare, connect
from checks.oracles import ORACLES
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0 and set(entry.oracle_sql()) <= set(entry.queries())
