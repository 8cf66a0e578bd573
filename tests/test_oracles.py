"""Every registered query against its SQL twin, at the scale of the gate."""

import os

import pytest
from check_oracles import compare, database

from tidemark import catalog

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    why, _ = compare(spark, db, QUERIES[name], ORACLES[name], SF)
    assert why is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0
