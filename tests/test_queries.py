"""Every query with a check agrees with it at the smallest scale."""

import math
import os

import duckdb
import pytest

from tracemill.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, database, name):
    got = queries.QUERIES[name](spark, SF)
    want = database.sql(queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)
