"""Every query with an oracle gives the same rows as the SQL."""

import os

import pytest

from clinfeat.plans import model_queries  # noqa: F401
from clinfeat.plans.catalogue import QUERIES
from clinfeat.plans.oracles import ORACLES
from compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
