import pytest

import __spark_entry__ as entry
from mosaic_spark.plans import sql

SF = "/root/testdata/sf0.001"


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "donor", "name", "chr", "start_bp", "end_bp", "state"] and df.count() > 0


def test_names_agree():
    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and len(found) > 40


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_against_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert len(a) == len(b) and all(x == pytest.approx(y) for x, y in zip(a, b))
