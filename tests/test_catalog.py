"""Every query runs; those with SQL give what an independent engine gives."""

import math
from collections import Counter

import pytest

from gridloom import catalog

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else x


def rows_of(rows):
    return Counter(tuple(plain(x) for x in r) for r in rows)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows_of(df.select(*columns).collect()) == rows_of(tuple(r[i] for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0
