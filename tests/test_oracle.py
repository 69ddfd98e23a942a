"""Every registered query against its SQL twin."""

import os

import pytest

import __spark_entry__ as entry
import oracle
from sluiceway.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.differences(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_every_query_has_a_twin_or_a_reason():
    # the library's tree learner has no SQL form
    assert set(QUERIES) - set(ORACLES) == {"q_tree_model"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
