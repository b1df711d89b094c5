"""Every registered analysis against its SQL on the smallest tables."""

import pytest

from traceloom.plans import registry

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def plain(rows, order):
    return sorted(([float(f"{v:.12g}") if isinstance(v, float) else v for v in (row[k] for k in order)] for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, data, name):
    df = registry.QUERIES[name](spark, data)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    assert plain(df.collect(), columns) == plain(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
