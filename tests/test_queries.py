"""Every query of the document engine against its SQL twin in DuckDB, and the others for rows and a stable schema."""

import os

import duckdb
import pytest

from quirework.plans import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def normal(rows):
    def one(v):
        if isinstance(v, float):
            return None if v != v else repr(round(v, 9))
        return str(sorted(v)) if isinstance(v, (list, tuple)) else v if v is None else str(v)

    return sorted([tuple(one(v) for v in r) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, db, name):
    got = queries.QUERIES[name](spark, DIR)
    want = db.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(got.select(*columns).collect()) == normal(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DIR)
    assert df.columns and df.count() > 0
