"""Every registered query with SQL gives the same rows as DuckDB."""

import datetime as dt
import decimal
import math

import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.fixture(scope="module")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, data, name):
    df = entry.queries()[name](spark, data)
    found = duck.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() == 10


def test_every_query_without_sql_gives_rows(spark, data):
    for name, query in entry.queries().items():
        if name not in entry.oracle_sql() and not name.startswith(("op", "pipeline")):
            assert query(spark, data).count() > 0, name
