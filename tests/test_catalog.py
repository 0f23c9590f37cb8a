"""Every registered query of the library against its SQL."""

import pytest
from conftest import DATA

from graphloom.plans import catalog


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else repr(x)
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in catalog.SQL:
        want = oracle.sql(catalog.SQL[name])
        assert canon(rows, df.columns) == canon(want.fetchall(), want.columns)
