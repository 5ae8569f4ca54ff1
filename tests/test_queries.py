"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

from logtide import catalogue, framed, system  # noqa: F401  framed and system register their queries

from .harness import compare, connection

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equal_to_sql(spark, con, name):
    assert compare(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], SF_DIR) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLE_SQL) <= set(__spark_entry__.queries())
