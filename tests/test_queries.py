"""Every query of the core against its SQL on the smallest data, and the driver's contract."""

import os

import duckdb
import pytest
from graphloom import queries_code, queries_export, queries_flows, queries_general, queries_graph, queries_rules, queries_symbols, queries_views

MODULES = (queries_general, queries_graph, queries_code, queries_symbols, queries_export, queries_views, queries_flows, queries_rules)
ALL = {k: v for m in MODULES for k, v in m.queries().items()}
SQL = {k: v for m in MODULES for k, v in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
    return c


def plain(frame, columns):
    def one(x):
        return "null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, small, name):
    got = ALL[name](spark, small).toPandas()
    if name in SQL:
        wanted = duck.sql(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(wanted.columns)
        assert plain(got, columns) == plain(wanted, columns)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(ALL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["edge_id", "endpoint"]
