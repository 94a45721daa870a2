from __future__ import annotations

import pytest

from nearfield import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_against_sql(against_sql, name):
    assert against_sql(name) > 0


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_others_give_rows(spark, name):
    assert core.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
