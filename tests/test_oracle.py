"""Every registered query against its SQL, on whole tables."""

import pytest

from staffloom.registry import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, folder, name):
    assert compare(spark, con, folder, name) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[-2:] == ["MOTIVO_CON_GOCE", "MOTIVO_SIN_GOCE"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
