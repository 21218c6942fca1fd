"""Every core query on the smallest tables: equal to its SQL, or at least it runs with a stable schema."""

import os

import oracle
import pytest

from quarrymill.plans.catalog import ORACLE, QUERIES

SLOW = {"cluster_stability", "co_association", "topic_hierarchy", "hungarian_match"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    oracle.compare(spark, oracle.DATA, name, QUERIES[name], ORACLE[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_runs(spark, name):
    df = QUERIES[name](spark, oracle.DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
