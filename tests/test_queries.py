"""Every query that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()
SF = "/root/testdata/sf0.001"


def test_names():
    assert set(SQL) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def plain(rows):
    text = lambda v: "" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(columns).collect()) == plain(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
