"""Each query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from controlspark import relational

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(relational.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in relational.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = relational.queries()[name](spark, SF)
    columns = sorted(got.columns)
    ours = sorted(tuple(repr(r[c]) for c in columns) for r in got.collect())
    cursor = con.execute(relational.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
