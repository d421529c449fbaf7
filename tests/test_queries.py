"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from carecolumns.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def same(a, b):
    return (a is None and b is None) or (isinstance(a, float) and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)) or a == b


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall()
    key = lambda r: tuple((v is not None, v if not isinstance(v, float) else round(v, 3)) for v in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)
