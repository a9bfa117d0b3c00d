"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

from peakloom.plans import ORACLE, QUERIES

from .conftest import SMALL
from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        assert_same(df, ORACLE[name], con)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5490
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
