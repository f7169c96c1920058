"""Smaller operators: composite values, collations, arrays of subqueries, more table functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from brindle.functions import arrays, jsons, maps, strings
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.session import load, register


@query("SELECT r_regionkey, array_to_string((SELECT array_agg(n_name ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey), ',') AS names FROM region")
def array_of_subquery(spark, d):
    # ARRAY(SELECT ...) that depends on the row is a grouped array, joined
    names = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(R.array_agg("n_name", ["n_name"]).alias("a"))
    return load(spark, d, "region").join(names, "r_regionkey", "left").select("r_regionkey", F.array_join("a", ",").alias("names"))


@query("SELECT c_custkey, c_mktsegment, c_nationkey + 1 AS next FROM customer WHERE (c_nationkey, c_mktsegment) > (20, 'HOUSEHOLD')")
def composite_compare(spark, d):
    c = load(spark, d, "customer").withColumn("pair", F.struct("c_nationkey", "c_mktsegment"))
    rows = c.filter(F.col("pair") > F.struct(F.lit(20).alias("c_nationkey"), F.lit("HOUSEHOLD").alias("c_mktsegment")))
    return rows.select("c_custkey", F.col("pair.c_mktsegment").alias("c_mktsegment"), (F.col("pair")["c_nationkey"] + 1).alias("next"))


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = lower('BRAND#11') OR lower(p_type) LIKE 'promo%'")
def case_insensitive_collation(spark, d):
    part = load(spark, d, "part")
    return part.filter((F.collate("p_brand", "UTF8_LCASE") == "bRaNd#11") | F.startswith(F.collate("p_type", "UTF8_LCASE"), F.lit("PROMO"))).select("p_partkey")


@query("SELECT o_orderkey, array_to_string(array_agg(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), '') AS recent FROM orders")
def window_array_agg(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return load(spark, d, "orders").select("o_orderkey", F.array_join(F.collect_list("o_orderstatus").over(w), "").alias("recent"))


@query("SELECT event_id, k AS key, json_extract_string(props, k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_each(spark, d):
    e = load(spark, d, "events").select("event_id", F.explode(jsons.each_text("props")).alias("p"))
    return e.select("event_id", "p.key", "p.value")


@query("SELECT n_nationkey, i AS place, x AS item FROM (SELECT n_nationkey, unnest([n_name, upper(n_name), '7']) AS x, unnest([1, 2, 3]) AS i FROM nation)")
def json_array_elements(spark, d):
    doc = F.to_json(F.array("n_name", F.upper("n_name"), F.lit("7")))
    rows = load(spark, d, "nation").select("n_nationkey", F.posexplode(jsons.elements_text(doc)).alias("at", "item"))
    return rows.select("n_nationkey", (F.col("at") + 1).alias("place"), "item")


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def json_to_record(spark, d):
    doc = jsons.row_to_json(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(1).alias("extra"))
    return load(spark, d, "nation").select("n_nationkey", jsons.populate_record(doc, "name string, region int").alias("r")).select("n_nationkey", "r.*")


@query("SELECT n_nationkey, unnest(string_split_regex(n_name, '[AEIOU]')) AS part FROM nation")
def regexp_split_to_table(spark, d):
    return load(spark, d, "nation").select("n_nationkey", F.explode(strings.regexp_split_to_array("n_name", "[AEIOU]")).alias("part"))


@query("SELECT n_nationkey, unnest(regexp_extract_all(n_name, '[AEIOU]')) AS vowel FROM nation")
def regexp_matches(spark, d):
    return load(spark, d, "nation").select("n_nationkey", F.explode(strings.regexp_matches("n_name", "[AEIOU]", "g")).alias("m")).select("n_nationkey", F.col("m")[0].alias("vowel"))


@query("SELECT n_nationkey, k AS key, CASE k WHEN 'name' THEN n_name ELSE n_regionkey::VARCHAR END AS value FROM nation, (VALUES ('name'), ('region')) t(k)")
def map_each(spark, d):
    h = maps.hstore(F.array(F.lit("name"), F.lit("region")), F.array("n_name", F.col("n_regionkey").cast("string")))
    return load(spark, d, "nation").select("n_nationkey", F.explode(h))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, count(*) AS n FROM nation GROUP BY 1")
def group_by_map(spark, d):
    h = F.create_map(F.lit("kind"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    rows = load(spark, d, "nation").select(h.alias("h")).groupBy(maps.group_key("h").alias("k")).agg(F.count("*").alias("n"))
    return rows.select(F.col("k")[0]["value"].alias("kind"), "n")


@query("SELECT c_custkey, c_name, c_acctbal, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(n, 0) > 0")
def group_by_primary_key(spark, d):
    rows = load(spark, d, "customer").join(load(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "c_acctbal", "o_orderkey")
    return R.group_by_primary_key(rows.drop("o_orderkey").withColumn("one", F.lit(1)), "c_custkey", F.count("*").alias("n")).drop("one")


@query("SELECT x, y FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) t(x, y)")
def rows_from_functions(spark, d):
    row = spark.range(1).select()
    return R.rows_from(row, {"x": F.sequence(F.lit(1), F.lit(3)), "y": F.split(F.lit("a,b"), ",")})


@query("SELECT p_partkey, len(list_distinct(string_split(p_name, ' '))) AS n, list_has_any(string_split(p_name, ' '), ['red', 'blue', 'green']) AS coloured FROM part")
def array_sets(spark, d):
    w = F.split("p_name", " ")
    return load(spark, d, "part").select("p_partkey", F.size(F.array_distinct(w)).alias("n"), arrays.arrayoverlap(w, F.array(*map(F.lit, ("red", "blue", "green")))).alias("coloured"))


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def event_buckets(spark, d):
    return load(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT table_name, column_name, ordinal_position FROM (VALUES ('catalogued', 'r_regionkey', 1), ('catalogued', 'r_name', 2)) t(table_name, column_name, ordinal_position)")
def catalog_columns(spark, d):
    from brindle.sources import catalog

    load(spark, d, "region").select("r_regionkey", "r_name").createOrReplaceTempView("catalogued")
    return catalog.columns(spark, "catalogued").select("table_name", "column_name", "ordinal_position")


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'fine' END AS state FROM customer WHERE c_nationkey BETWEEN 2 AND 5")
def view_over_view(spark, d):
    register(spark, d, "customer")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW states AS SELECT *, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE 'fine' END AS state FROM customer")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW some_states AS SELECT c_custkey, c_acctbal, state FROM states WHERE c_nationkey BETWEEN 2 AND 5")
    return spark.table("some_states")
