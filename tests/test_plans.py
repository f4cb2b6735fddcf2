"""Every registered query runs on the smallest tables; those with SQL give what DuckDB gives."""

import duckdb
import pytest

from tessera import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def normal(row):
    return tuple(f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, con, name):
    df = plans.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(normal(r) for r in df.select(*cols).collect())
    if name not in plans.ORACLE:
        return
    r = con.sql(plans.ORACLE[name])
    assert sorted(r.columns) == cols
    kinds = dict(zip(r.columns, map(str, r.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(normal(tuple(x[i] for i in at)) for x in r.fetchall())
