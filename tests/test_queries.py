"""Every query of the library against its SQL on the same tables."""

import decimal
import math

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else round(x, 6) if isinstance(x, float) and math.isfinite(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in got.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert found == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=str)


def test_entry_points():
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries()) and "rrf01_fused_search" in e.oracle_sql()
