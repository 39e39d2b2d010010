"""The queries of the llm problems on the smallest data."""

import os

import duckdb
import pytest
from graphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    assert len(got) == len(got.drop_duplicates([c for c in got.columns if c != "ids"]))
    if name in queries.oracle_sql():
        c = duckdb.connect()
        for f in os.listdir(small):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{small}/{f}'")
        wanted = c.sql(queries.oracle_sql()[name]).df()
        assert sorted(map(tuple, got[wanted.columns].values.tolist())) == sorted(map(tuple, wanted.values.tolist()))
