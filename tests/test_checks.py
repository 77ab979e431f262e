"""Every registered query against its check SQL on the smallest tables."""

import checking
import pytest
from checking import SMALL

import __spark_entry__ as entry
from lectern.plans import CHECKS, QUERIES


@pytest.fixture(scope="module")
def duck():
    return checking.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    if name not in CHECKS:
        assert frame.count() > 0
        return
    message, _ = checking.differences(frame, duck, CHECKS[name])
    assert message is None, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_have_sql():
    assert set(QUERIES) == set(CHECKS)
    assert set(QUERIES) <= set(entry.queries())
