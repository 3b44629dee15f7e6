"""Each query of the engine against its SQL on the smallest tables, and each worked example against its own."""

from __future__ import annotations

import pytest

from conftest import SMALL
from tessella.plans import registry

EXAMPLES = registry.examples()
QUERIES = registry.queries() | {name: f for name, (f, _) in EXAMPLES.items()}
SQL = registry.oracle_sql() | {name: sql for name, (_, sql) in EXAMPLES.items() if sql}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, same_rows, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    if name in SQL:
        same_rows(got, duck.sql(SQL[name]).df())
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
