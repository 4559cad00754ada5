"""Every registered query of the engine against its DuckDB SQL."""

import pytest
from conftest import rows_of

from weftline import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    found = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        assert rows_of(found) == rows_of(duck.execute(SQL[name]).df())
    else:
        assert len(found) > 0


def test_names_are_unique():
    assert len(QUERIES) == sum(len(r.queries) for r in catalog.REGISTRIES)
