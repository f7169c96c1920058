"""The small read queries of the common transactional benchmark, on the orders table."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans.registry import query
from brindle.session import load


def _orders(spark, d):
    return load(spark, d, "orders")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 5")
def point_select(spark, d):
    return _orders(spark, d).filter("o_orderkey = 5").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 77, 301, 1022, 1499)")
def select_random_points(spark, d):
    return _orders(spark, d).filter(F.col("o_orderkey").isin(1, 77, 301, 1022, 1499)).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey BETWEEN 10 AND 15 OR o_orderkey BETWEEN 500 AND 505 OR o_orderkey BETWEEN 900 AND 905")
def select_random_ranges(spark, d):
    k = F.col("o_orderkey")
    return _orders(spark, d).filter(k.between(10, 15) | k.between(500, 505) | k.between(900, 905)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE o_custkey > 100")
def covering_index_scan(spark, d):
    return _orders(spark, d).filter("o_custkey > 100").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey < 50")
def index_scan(spark, d):
    return _orders(spark, d).filter("o_custkey < 50").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT year(o_orderdate) AS y, count(*) AS n, max(o_orderkey) AS top FROM orders GROUP BY 1")
def groupby_scan(spark, d):
    return _orders(spark, d).groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey BETWEEN 100 AND 200")
def index_join(spark, d):
    rows = _orders(spark, d).filter(F.col("o_orderkey").between(100, 200)).select("o_orderkey", "o_custkey")
    return rows.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey < 20")
def index_join_scan(spark, d):
    c = load(spark, d, "customer").filter("c_custkey < 20").select("c_custkey", "c_name")
    return _orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%URGENT' AND o_totalprice > 300000")
def table_scan(spark, d):
    return _orders(spark, d).filter("o_orderpriority LIKE '%URGENT' AND o_totalprice > 300000").select("o_orderkey", "o_orderpriority")


@query("SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_linenumber = 1")
def types_table_scan(spark, d):
    return load(spark, d, "lineitem").filter("l_quantity > 45 AND l_returnflag = 'R' AND l_shipdate < TIMESTAMP_NTZ '1999-01-01' AND l_linenumber = 1")
