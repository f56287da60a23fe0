import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n in entry.oracle_sql() and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    r = db.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(df.columns) == sorted(columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert got == sorted(map(str, (tuple(row[i] for i in order) for row in r.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() == 5
