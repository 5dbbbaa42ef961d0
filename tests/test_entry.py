import duckdb
import pytest

import __spark_entry__ as e

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(e.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    cur = con.execute(e.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = e.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
