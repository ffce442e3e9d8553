"""Every named query against its SQL twin on the given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, differences
from tokenloom.catalog import all_oracles, all_queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_twin(spark, con, name):
    assert not differences(all_queries()[name](spark, SF), con, all_oracles()[name])


def test_entry_points_hold_the_catalog():
    assert set(all_queries()) <= set(queries()) and set(all_oracles()) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert {r["split"] for r in entry(spark).collect()} <= {"train", "val"}


def test_known_budget(spark):
    """Known result at this size: the pack stops at document 200."""
    rows = {r["split"]: r for r in queries()["token_budget_pack"](spark, SF).collect()}
    assert rows["train"]["tokens"] == 500_327 and rows["val"]["tokens"] == 6_002
    assert max(r["last_doc"] for r in rows.values()) == 200
