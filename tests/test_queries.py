"""Every registered query of the core against its SQL, on the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

from quillmere import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def tables(sf):
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def canon(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, tables, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(canon(r[c]) for c in columns) for r in df.collect())
    if name in catalogue.SQL:
        result = tables.execute(catalogue.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == Counter(tuple(canon(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["link_id", "target", "rule_id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
