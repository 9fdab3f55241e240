"""Every registered query with a SQL twin equals DuckDB's result on the
smallest driver tables (the driver repeats this at sf0.01)."""

import os

import pytest

from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", _names())
def test_query_matches_duckdb(spark, con, name):
    import __spark_entry__ as E
    res = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert res["status"] == "match", res


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
