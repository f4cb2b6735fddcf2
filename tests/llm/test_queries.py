import __spark_entry__ as entry
import duckdb
import pytest

from tessera.llm import queries as q


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(map(str, r)) for r in df.select(*cols).collect()))
    r = con.sql(q.ORACLE[name])
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(tuple(str(x[i]) for i in at) for x in r.fetchall())
