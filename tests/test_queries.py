"""Every registered query against its SQL on the smallest tables; the rest has to run."""

import os

import oracle
import pytest

from tracelens import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    if name in queries.ORACLE_SQL:
        assert oracle.compare(spark, con, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""
    else:
        assert queries.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0
