"""Relational queries: scans, predicates, joins, aggregation, windows, sorting, set operations, table functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import arrays, vectors
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.session import load, register

MONEY = "decimal(18,2)"


def money(name: str):
    return F.col(name).cast(MONEY)


def money_sum(x, digits: int = 2, over=None):
    """The exact sum of amounts that are stored as doubles, as a decimal.

    Amounts become whole numbers of their last digit before they are summed, which no row needs its decimal text for.
    """
    units = F.rint((F.col(x) if isinstance(x, str) else x) * 10**digits).cast("long").cast("decimal(18,0)")
    total = F.sum(units)
    return (total if over is None else total.over(over)).cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-digits))


@query("""
    SELECT c_mktsegment, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2)) AS revenue, round(avg(l_quantity), 6) AS avg_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 10""")
def flagship_segment_revenue(spark: SparkSession, d: str) -> DataFrame:
    line, orders, customer = (load(spark, d, t) for t in ("lineitem", "orders", "customer"))
    line = line.filter(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    # the large table comes last and meets an order's segment, all that it needs of the other two
    segments = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "c_mktsegment")
    joined = line.join(segments, F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), money_sum("l_extendedprice").alias("revenue"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"))
    return R.limit_offset(out, [R.desc("revenue")], 10)


# Scans, projection, predicates


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04 AND l_shipdate < TIMESTAMP '1996-01-01'")
def scan_filter_project(spark, d):
    cutoff = F.lit("1996-01-01").cast("timestamp_ntz")
    return load(spark, d, "lineitem").filter((F.col("l_quantity") > 45) & F.col("l_discount").between(0.02, 0.04) & (F.col("l_shipdate") < cutoff)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
    SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS closed, o_totalprice NOT BETWEEN 1000 AND 100000 AS extreme,
           o_orderpriority LIKE '1%' AS urgent, o_orderpriority ILIKE '%HIGH%' AS high, regexp_matches(o_orderpriority, '^[12]-') AS top,
           regexp_full_match(o_orderpriority, '(1|2)-.*') AS similar, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size,
           coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, o_orderstatus IS DISTINCT FROM 'O' AS moved
    FROM orders""")
def predicates(spark, d):
    from brindle.functions import strings as S

    o = load(spark, d, "orders")
    price, priority, status = F.col("o_totalprice"), F.col("o_orderpriority"), F.col("o_orderstatus")
    return o.select(
        "o_orderkey",
        status.isin("F", "P").alias("closed"),
        (~price.between(1000, 100000)).alias("extreme"),
        S.like(priority, "1%").alias("urgent"),
        S.ilike(priority, "%HIGH%").alias("high"),
        S.regex_match(priority, "^[12]-").alias("top"),
        S.similar_to(priority, "(1|2)-%").alias("similar"),
        F.when(price > 200000, "big").when(price > 50000, "mid").otherwise("small").alias("size"),
        F.coalesce(F.nullif(status, F.lit("O")), F.lit("open")).alias("status"),
        (~status.eqNullSafe("O")).alias("moved"),
    )


@query("""
    SELECT p_partkey, p_size // 7 AS quotient, p_size % 7 AS rest, -p_size AS minus, p_size & 12 AS band, p_size | 3 AS bor, xor(p_size, 5) AS bxor,
           p_size << 2 AS shl, p_size >> 1 AS shr, p_brand || '/' || p_type AS label, (p_retailprice * 2)::DECIMAL(18,2) AS twice
    FROM part""")
def arithmetic_operators(spark, d):
    size = F.col("p_size")
    return load(spark, d, "part").select(
        "p_partkey",
        F.expr("p_size div 7").alias("quotient"),
        (size % 7).alias("rest"),
        (-size).alias("minus"),
        size.bitwiseAND(12).alias("band"),
        size.bitwiseOR(3).alias("bor"),
        size.bitwiseXOR(5).alias("bxor"),
        F.shiftleft(size, 2).alias("shl"),
        F.shiftright(size, 1).alias("shr"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("label"),
        (F.col("p_retailprice") * 2).cast(MONEY).alias("twice"),
    )


@query("SELECT * FROM (VALUES (1, 'a', 1.5), (2, NULL, 2.5), (3, 'c', NULL)) AS t(id, name, x)")
def values_rows(spark, d):
    return R.values(spark, [(1, "a", 1.5), (2, None, 2.5), (3, "c", None)], ["id", "name", "x"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def in_subquery(spark, d):
    nations = load(spark, d, "nation").filter("n_regionkey = 1")
    return load(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def not_in_subquery(spark, d):
    orders = load(spark, d, "orders").filter("o_totalprice > 100000")
    return R.not_in(load(spark, d, "customer").select("c_custkey"), "c_custkey", orders, "o_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer")
def exists_subquery(spark, d):
    register(spark, d, "orders", "customer")
    return spark.sql("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_f FROM customer")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(spark, d):
    register(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")


@query("SELECT p_partkey, p_size = ANY ([1, 7, 49]) AS any_of, p_size <> ALL ([1, 7, 49]) AS none_of FROM part")
def any_all_array(spark, d):
    sizes = F.array(*map(F.lit, (1, 7, 49)))
    return load(spark, d, "part").select("p_partkey", arrays.any_equal(F.col("p_size"), sizes).alias("any_of"), (~arrays.any_equal(F.col("p_size"), sizes)).alias("none_of"))


# Joins


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(o_orderkey) AS n, sum(o_totalprice::DECIMAL(18,2)) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, d):
    # orders are summed before the join, which then meets a row for each customer
    sums = load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), money_sum("o_totalprice").alias("total"))
    joined = load(spark, d, "customer").select("c_custkey").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), "total")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, d):
    return load(spark, d, "supplier").join(load(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("""
    SELECT c_nationkey, s_nationkey, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
    FULL JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON c_nationkey = s_nationkey""")
def join_full(spark, d):
    a = load(spark, d, "customer").filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    b = load(spark, d, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("s"))
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 3")
def join_cross(spark, d):
    return load(spark, d, "region").select("r_name").crossJoin(load(spark, d, "nation").filter("n_nationkey < 3").select("n_name"))


@query("SELECT r_regionkey, r_name, n_name FROM (SELECT * FROM region) JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) USING (r_regionkey)")
def join_using(spark, d):
    nation = load(spark, d, "nation").select(F.col("n_regionkey").alias("r_regionkey"), "n_name")
    return load(spark, d, "region").join(nation, "r_regionkey")


@query("SELECT c_custkey, r_name FROM customer JOIN region ON c_acctbal >= r_regionkey * 2500 AND c_nationkey <> r_regionkey")
def join_theta(spark, d):
    # no equality: the region table's few rows go to every task
    c, r = load(spark, d, "customer"), load(spark, d, "region")
    return c.join(r, (c.c_acctbal >= r.r_regionkey * 2500) & (c.c_nationkey != r.r_regionkey)).select("c_custkey", "r_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_residual(spark, d):
    nation = load(spark, d, "nation")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return nation.alias("a").join(nation.alias("b"), on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 180000)")
def join_anti(spark, d):
    orders = load(spark, d, "orders").filter("o_totalprice > 180000")
    return load(spark, d, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM (
        SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey) WHERE rn <= 2""")
def lateral_top_n(spark, d):
    register(spark, d, "customer", "orders")
    return spark.sql("""
        SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (
            SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) ON true""")


@query("SELECT n_name, biggest FROM nation, LATERAL (SELECT max(c_acctbal) AS biggest FROM customer WHERE c_nationkey = n_nationkey) x")
def lateral_aggregate(spark, d):
    register(spark, d, "nation", "customer")
    return spark.sql("SELECT n_name, biggest FROM nation, LATERAL (SELECT max(c_acctbal) AS biggest FROM customer WHERE c_nationkey = n_nationkey) x")


# Aggregation


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2)) AS sum_qty, sum(l_extendedprice::DECIMAL(18,2)) AS sum_base,
           sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4)) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def group_by(spark, d):
    line = load(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        money_sum("l_quantity").alias("sum_qty"),
        money_sum("l_extendedprice").alias("sum_base"),
        money_sum(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("n"),
    )


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2)) AS q, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup(spark, d):
    # rows are summed by all keys first; only those sums are repeated for the coarser groups
    finest = load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(money_sum("l_quantity").alias("q"))
    return finest.rollup("l_returnflag", "l_linestatus").agg(F.sum("q").alias("q"), F.grouping("l_returnflag").cast("int").alias("g1"), F.grouping("l_linestatus").cast("int").alias("g2"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    finest = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return finest.cube("o_orderstatus", "o_orderpriority").agg(F.sum("n").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    finest = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return finest.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.sum("n").alias("n"))


@query("""
    SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, round(stddev_samp(c_acctbal), 4) AS sds,
           round(variance(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp, round(var_samp(c_acctbal), 2) AS vs,
           bit_and(c_custkey) AS ba, bit_or(c_custkey) AS bo, bit_xor(c_custkey) AS bx, bool_and(c_acctbal > -1000) AS ball, bool_or(c_acctbal > 9990) AS bany,
           count(DISTINCT c_nationkey) AS nations, sum(DISTINCT c_nationkey) AS nation_sum, min(c_name) AS lo, max(c_name) AS hi
    FROM customer GROUP BY c_mktsegment""")
def aggregate_functions(spark, d):
    x, k = F.col("c_acctbal"), F.col("c_custkey")
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(
        F.round(F.stddev(x), 4).alias("sd"), F.round(F.stddev_pop(x), 4).alias("sdp"), F.round(F.stddev_samp(x), 4).alias("sds"),
        F.round(F.variance(x), 2).alias("v"), F.round(F.var_pop(x), 2).alias("vp"), F.round(F.var_samp(x), 2).alias("vs"),
        F.bit_and(k).alias("ba"), F.bit_or(k).alias("bo"), F.bit_xor(k).alias("bx"), F.bool_and(x > -1000).alias("ball"), F.bool_or(x > 9990).alias("bany"),
        F.count_distinct("c_nationkey").alias("nations"), F.sum_distinct("c_nationkey").alias("nation_sum"), F.min("c_name").alias("lo"), F.max("c_name").alias("hi"),
    )


@query("""
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_totalprice > 100000) AS big,
           count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS open_customers
    FROM orders GROUP BY o_orderpriority""")
def aggregate_filter(spark, d):
    register(spark, d, "orders")
    return spark.sql("""
        SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_totalprice > 100000) AS big,
               count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS open_customers
        FROM orders GROUP BY o_orderpriority""")


@query("""
    SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), ',') AS names, string_agg(n_name, '; ' ORDER BY n_name) AS text,
           array_to_string(list_sort(array_agg(DISTINCT n_nationkey % 3)), ',') AS rests
    FROM nation GROUP BY n_regionkey""")
def array_and_string_agg(spark, d):
    return load(spark, d, "nation").groupBy("n_regionkey").agg(
        F.array_join(R.array_agg("n_name", ["n_nationkey"]), ",").alias("names"),
        R.string_agg("n_name", "; ", ["n_name"]).alias("text"),
        F.array_join(R.array_agg(F.col("n_nationkey") % 3, distinct=True), ",").alias("rests"),
    )


@query("""
    SELECT n_regionkey, '[' || string_agg('"' || n_name || '"', ', ' ORDER BY n_name) || ']' AS names,
           '{' || string_agg('"' || n_name || '": ' || n_nationkey, ', ' ORDER BY n_name) || '}' AS pairs
    FROM nation GROUP BY n_regionkey""")
def json_aggregates(spark, d):
    return load(spark, d, "nation").groupBy("n_regionkey").agg(R.json_agg("n_name", ["n_name"]).alias("names"), R.json_object_agg("n_name", "n_nationkey").alias("pairs"))


@query("""
    SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90,
           1 + count(*) FILTER (WHERE l_quantity < 25) AS rank_of_25
    FROM lineitem GROUP BY l_returnflag""")
def ordered_set_aggregates(spark, d):
    register(spark, d, "lineitem")
    return spark.sql("""
        SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS median, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90,
               1 + count_if(l_quantity < 25) AS rank_of_25
        FROM lineitem GROUP BY l_returnflag""")


@query("""
    SELECT p_brand, p_size AS most FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS rn
    FROM part GROUP BY p_brand, p_size) WHERE rn = 1""")
def mode_aggregate(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(R.mode("p_size").alias("most"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, d):
    return load(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on(spark, d):
    return R.distinct_on(load(spark, d, "orders"), ["o_custkey"], [R.desc("o_orderdate"), R.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT sum(c_custkey)::DECIMAL(38,0) AS wide, round(avg(c_nationkey), 6) AS mean, count(*) AS n FROM customer")
def global_aggregate(spark, d):
    return load(spark, d, "customer").agg(R.sum_wide("c_custkey").alias("wide"), F.round(F.avg("c_nationkey"), 6).alias("mean"), F.count("*").alias("n"))


# Windows


@query("""
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS r, dense_rank() OVER p AS dr, round(percent_rank() OVER p, 9) AS pr, round(cume_dist() OVER p, 9) AS cd, ntile(4) OVER w AS quarter
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_ranks(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(R.asc("o_totalprice"), R.asc("o_orderkey"))
    p = Window.partitionBy("o_custkey").orderBy(R.asc("o_orderpriority"))
    return load(spark, d, "orders").select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(p).alias("r"), F.dense_rank().over(p).alias("dr"),
        F.round(F.percent_rank().over(p), 9).alias("pr"), F.round(F.cume_dist().over(p), 9).alias("cd"), F.ntile(4).over(w).alias("quarter"),
    )


@query("""
    SELECT o_orderkey, lag(o_orderkey) OVER w AS l1, lag(o_orderkey, 2, -1) OVER w AS l2, lead(o_orderkey) OVER w AS n1, first_value(o_orderkey) OVER w AS f,
           last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER w AS second
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_values(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    k = "o_orderkey"
    return load(spark, d, "orders").select(
        k, F.lag(k).over(w).alias("l1"), F.lag(k, 2, -1).over(w).alias("l2"), F.lead(k).over(w).alias("n1"), F.first_value(k).over(w).alias("f"), F.last_value(k).over(whole).alias("l"), F.nth_value(k, 2).over(w).alias("second"),
    )


@query("""
    SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, sum(o_totalprice::DECIMAL(18,2)) OVER w AS running,
           count(*) OVER (w RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS ranged,
           bool_or(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS partial, min(o_totalprice) OVER (PARTITION BY o_custkey) AS least
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def window_frames(spark, d):
    by = Window.partitionBy("o_custkey")
    w = by.orderBy("o_orderkey")
    return load(spark, d, "orders").select(
        "o_orderkey", money_sum("o_totalprice", over=w.rowsBetween(-1, 1)).alias("near"), money_sum("o_totalprice", over=w).alias("running"), F.count("*").over(w.rangeBetween(-5000, 0)).alias("ranged"),
        F.bool_or(F.col("o_orderstatus") == "P").over(by).alias("partial"), F.min("o_totalprice").over(by).alias("least"),
    )


# Sorting, limits, sets, common tables


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def limit_offset(spark, d):
    return R.limit_offset(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), [R.desc("o_totalprice"), R.asc("o_orderkey")], 20, 5)


@query("SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def fetch_with_ties(spark, d):
    return R.with_ties(load(spark, d, "part").select("p_partkey", "p_size"), 10, [R.desc("p_size")])


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, d):
    return load(spark, d, "customer").filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")).union(load(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def intersect_distinct(spark, d):
    return load(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(load(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark, d):
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(load(spark, d, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
def except_distinct(spark, d):
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k")).subtract(load(spark, d, "supplier").filter("s_acctbal > 7000").select("s_nationkey"))


@query("SELECT s_nationkey AS k FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation")
def except_all(spark, d):
    return load(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).exceptAll(load(spark, d, "nation").select("n_nationkey"))


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), by_customer AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT c_mktsegment, sum(n)::BIGINT AS n FROM by_customer JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def common_table(spark, d):
    big = load(spark, d, "orders").filter("o_totalprice > 150000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return big.join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("n").alias("n"))


@query("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
def recursive_table(spark, d):
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def parameters(spark, d):
    register(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_orderstatus = :status", args={"since": "1997-01-01", "status": "F"})


# Table functions


@query("SELECT i AS generate_series FROM generate_series(1, 1000, 7) t(i)")
def generate_series(spark, d):
    return R.generate_series(spark, 1, 1000, 7)


@query("SELECT i AS at FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 6 HOUR) t(i)")
def generate_series_times(spark, d):
    return R.generate_series(spark, "2024-01-01", "2024-01-03", "6 hours", "at")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_array(spark, d):
    return R.unnest(load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("word")), "word")


@query("SELECT x, y, ordinality FROM (VALUES (1, 'a', 1), (2, 'b', 2), (3, NULL, 3)) t(x, y, ordinality)")
def unnest_several(spark, d):
    row = spark.range(1).select(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("x"), F.array(F.lit("a"), F.lit("b")).alias("y"))
    return R.unnest(row, "x", "y", ordinality="ordinality")


@query("SELECT p_partkey, unnest(generate_series(1, len(string_split(p_name, ' ')))) AS i FROM part")
def generate_subscripts(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    return R.generate_subscripts(part, "words").drop("words")


@query("SELECT event_id, t.k AS key FROM events, (SELECT unnest(json_keys(props)) AS k) t")
def json_object_keys(spark, d):
    from brindle.functions import jsons

    return load(spark, d, "events").select("event_id", F.explode(jsons.object_keys("props")).alias("key"))


# Vectors


@query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 5) AS distance
    FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_sum(list_transform(list_zip(embedding, q), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2)), vec_id LIMIT 10""")
def vector_nearest(spark, d):
    e = load(spark, d, "embeddings")
    q = e.filter("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    near = e.crossJoin(F.broadcast(q)).select("vec_id", vectors.l2_distance("embedding", F.col("q")).alias("exact")).orderBy("exact", "vec_id").limit(10)
    return near.select("vec_id", F.round("exact", 5).alias("distance"))


@query("""
    SELECT query_id, vec_id, round(exact, 5) AS distance FROM (
        SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS exact
        FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY exact, vec_id) <= 10""")
def vector_nearest_all(spark, d):
    """Every twentieth vector as a query against all rows; each task keeps ten rows a query before the shuffle."""
    e = load(spark, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = e.crossJoin(q).select("query_id", "vec_id", vectors.l2_distance("embedding", F.col("q")).alias("exact"))
    near = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("exact", "vec_id"))).filter("place <= 10")
    return near.select("query_id", "vec_id", F.round("exact", 5).alias("distance"))


@query("""
    SELECT label, i - 1 AS at, round(avg(embedding[i]::DOUBLE), 5) AS mean FROM embeddings, generate_series(1, (SELECT max(len(embedding)) FROM embeddings)) t(i)
    WHERE i <= len(embedding) GROUP BY label, i""")
def vector_average(spark, d):
    mean = vectors.vector_aggregate(load(spark, d, "embeddings"), ["label"], "embedding", "avg", "mean")
    return mean.select("label", F.posexplode("mean").alias("at", "x")).select("label", F.col("at").cast("long").alias("at"), F.round("x", 5).alias("mean"))


@query("""
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 4) AS inner_product, round(1 - list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 5) AS cosine,
           round(list_sum(list_transform(list_zip(embedding, q), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 4) AS l1, len(embedding) AS dims
    FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 1)""")
def vector_distances(spark, d):
    e = load(spark, d, "embeddings")
    one = e.filter("vec_id = 1").limit(1).select(F.col("embedding").alias("q"))
    q = F.col("q")
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(vectors.inner_product("embedding", q), 4).alias("inner_product"), F.round(vectors.cosine_distance("embedding", q), 5).alias("cosine"), F.round(vectors.l1_distance("embedding", q), 4).alias("l1"), vectors.vector_dims("embedding").alias("dims"))
