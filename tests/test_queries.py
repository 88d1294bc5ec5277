"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import __spark_entry__
from glossgraph import registry as queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(repr(round(x, 6) if isinstance(x, float) else x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert plain(map(tuple, df.select(*columns).collect())) == plain(found)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
