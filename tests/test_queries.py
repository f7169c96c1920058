"""Every registered query of the engine itself against DuckDB."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from brindle.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(datetime.datetime(*x.timetuple()[:6]))
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, duck, name):
    df = registry.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(sql)
    assert rows_of(df.columns, rows) == rows_of(found.columns, found.fetchall())
