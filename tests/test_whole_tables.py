"""Queries that must read their whole table, without id subsets, modulo filters or limits."""

import pytest

from brindle.plans import registry


@pytest.mark.parametrize(("name", "table", "key"), [("unnest_array", "part", "p_partkey"), ("generate_subscripts", "part", "p_partkey"), ("json_each", "events", "event_id")])
def test_unnesting_keeps_every_row(spark, name, table, key):
    data = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select(key).collect()}
    assert {r[key] for r in registry.queries()[name](spark, data).collect()} == ids


@pytest.mark.parametrize(("name", "table", "key"), [("sql_distinct_on", "orders", "o_custkey"), ("sql_json_operators", "events", "event_id")])
def test_texts_keep_every_row(spark, name, table, key):
    data = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{data}/{table}.parquet")
    rows = rows.filter("o_totalprice > 1000") if table == "orders" else rows
    ids = {r[0] for r in rows.select(key).collect()}
    got = [r[key] for r in registry.queries()[name](spark, data).collect()]
    assert set(got) == ids and len(got) == len(ids)


def test_every_twentieth_vector_is_a_query(spark):
    data = "/root/testdata/sf0.01"
    ids = {r[0] for r in spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id % 20 = 0").select("vec_id").collect()}
    rows = registry.queries()["vector_nearest_all"](spark, data).collect()
    assert {r.query_id for r in rows} == ids and len(rows) == 10 * len(ids)
