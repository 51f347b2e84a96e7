"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from checks import ORACLES, QUERIES
from checks.compare import connect, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    rows = [tuple(r) for r in frame.collect()]
    result = duck.execute(ORACLES[name])
    expected = result.fetchall()
    assert difference(frame.columns, rows, [c[0] for c in result.description], expected) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    """No SQL says these; they run over whole tables and give rows of a stable schema."""
    frame = QUERIES[name](spark, SF_DIR)
    assert frame.columns and frame.collect() is not None
