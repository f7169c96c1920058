"""Queries for data changes, constraints, version control, COPY and change streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import dml
from brindle.operators.versions import VersionStore, diff_tables, merge_tables
from brindle.plans.registry import query
from brindle.session import load, scratch
from brindle.sources import copy
from brindle.streaming import changes


def _customers(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal"))


_C = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer)"

# Data changes


@query(f"SELECT * FROM {_C} UNION ALL SELECT c_custkey + 1000000, 'new', NULL, 0 FROM {_C} WHERE c_custkey % 10 = 0")
def insert_rows(spark, d):
    c = _customers(spark, d)
    new = c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0).cast("decimal(18,2)").alias("c_acctbal"))
    return dml.insert(c, new)


@query(f"SELECT * FROM {_C} UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal FROM {_C} WHERE c_custkey % 4 = 0")
def insert_on_conflict_nothing(spark, d):
    c = _customers(spark, d)
    rows = c.filter("c_custkey % 2 = 0").withColumn("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")))
    return dml.insert_on_conflict_nothing(c, rows, ["c_custkey"])


@query(f"""
    SELECT c_custkey, c_name, c_nationkey, (c_acctbal + CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN 100 ELSE 0 END)::DECIMAL(18,2) AS c_acctbal FROM {_C}
    UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, 100 FROM {_C} WHERE c_custkey % 3 = 1""")
def upsert(spark, d):
    c = _customers(spark, d)
    rows = c.filter("c_custkey % 3 < 2").withColumn("c_custkey", F.when(F.col("c_custkey") % 3 == 1, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))).withColumn("c_acctbal", F.lit(100).cast("decimal(18,2)"))
    return dml.upsert(c, rows, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("excluded.c_acctbal")}, where=F.col("t.c_acctbal") > 0)


@query(f"SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN upper(c_name) ELSE c_name END AS c_name, c_nationkey, (CASE WHEN c_nationkey = 3 THEN 2 ELSE 1 END * c_acctbal)::DECIMAL(18,2) AS c_acctbal FROM {_C}")
def update_rows(spark, d):
    return dml.update(_customers(spark, d), {"c_name": F.upper("c_name"), "c_acctbal": F.col("c_acctbal") * 2}, F.col("c_nationkey") == 3)


@query(f"SELECT c_custkey, coalesce(n_name, c_name) AS c_name, c_nationkey, c_acctbal FROM {_C} LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 2) ON c_nationkey = n_nationkey")
def update_from_join(spark, d):
    nation = load(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return dml.update_from(_customers(spark, d), nation, ["c_nationkey"], {"c_name": F.col("s.n_name")})


@query(f"SELECT * FROM {_C} WHERE NOT (c_acctbal < 0)")
def delete_rows(spark, d):
    return dml.delete(_customers(spark, d), F.col("c_acctbal") < 0)


@query(f"SELECT * FROM {_C} WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def delete_using_join(spark, d):
    orders = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dml.delete_using(_customers(spark, d), orders, ["c_custkey"])


@query(f"""
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_acctbal END::DECIMAL(18,2) AS c_acctbal FROM {_C} WHERE NOT (c_custkey % 5 = 1)
    UNION ALL SELECT c_custkey + 1000000, c_name, NULL, 1 FROM {_C} WHERE c_custkey % 5 = 2""")
def merge_into(spark, d):
    c = _customers(spark, d)
    source = c.filter("c_custkey % 5 < 3").withColumn("c_custkey", F.when(F.col("c_custkey") % 5 == 2, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")))
    return dml.merge(
        c, source, ["c_custkey"],
        matched=[(F.col("s.c_custkey") % 5 == 1, "delete"), (None, {"c_acctbal": F.lit(0)})],
        not_matched=[(None, {"c_custkey": F.col("s.c_custkey"), "c_name": F.col("s.c_name"), "c_acctbal": F.lit(1)})],
    )


# Statements


def _database(spark, d):
    from brindle.plans.statements import PgDatabase

    return PgDatabase(spark, customer=_customers(spark, d))


@query(f"SELECT c_custkey + 1000000 AS id, upper(c_name) AS name, 5::DECIMAL(18,2) AS balance FROM {_C} WHERE c_nationkey = 2")
def statement_insert_returning(spark, d):
    return _database(spark, d).sql("INSERT INTO customer (c_custkey, c_name, c_acctbal) SELECT c_custkey + 1000000, upper(c_name), 5 FROM customer WHERE c_nationkey = 2 RETURNING c_custkey AS id, c_name AS name, c_acctbal AS balance")


@query(f"SELECT c_custkey, c_name, c_nationkey, (c_acctbal + CASE WHEN c_nationkey = 7 AND c_acctbal > 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS c_acctbal FROM {_C}")
def statement_on_conflict(spark, d):
    base = _database(spark, d)
    base.sql("INSERT INTO customer AS c SELECT c_custkey, c_name, c_nationkey, 1 FROM customer WHERE c_nationkey = 7 ON CONFLICT (c_custkey) DO UPDATE SET c_acctbal = c.c_acctbal + excluded.c_acctbal WHERE c.c_acctbal > 0")
    return base.sql("SELECT * FROM customer")


@query(f"SELECT c_custkey, (c_acctbal * 2)::DECIMAL(18,2) AS doubled FROM {_C} WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)")
def statement_update_returning(spark, d):
    load(spark, d, "nation").createOrReplaceTempView("nation")
    return _database(spark, d).sql("UPDATE customer AS c SET c_acctbal = c.c_acctbal * 2, c_name = lower(c_name) WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) RETURNING c_custkey, c_acctbal AS doubled")


@query(f"SELECT c_custkey, coalesce((SELECT min(o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000), c_name) AS c_name, c_nationkey, c_acctbal FROM {_C}")
def statement_update_from(spark, d):
    # many orders meet a customer; it is changed once, by the least of the new values
    load(spark, d, "orders").createOrReplaceTempView("orders")
    base = _database(spark, d)
    base.sql("UPDATE customer SET c_name = o.o_orderpriority FROM orders o WHERE o.o_custkey = c_custkey AND o.o_totalprice > $1", 150000)
    return base.sql("SELECT * FROM customer")


@query(f"SELECT c_custkey, c_name FROM {_C} WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def statement_delete_returning(spark, d):
    load(spark, d, "orders").createOrReplaceTempView("orders")
    return _database(spark, d).sql("DELETE FROM customer USING orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' RETURNING c_custkey, c_name")


@query(f"SELECT 'new' AS place, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM {_C} WHERE c_acctbal < 0 UNION ALL SELECT 'old', count(*), sum(c_custkey)::BIGINT FROM {_C} WHERE c_acctbal >= 0 UNION ALL SELECT 'seen', count(*), sum(c_custkey)::BIGINT FROM {_C}")
def statement_changes_in_with(spark, d):
    # rows move from one table to another; the statement itself still sees them all
    base = _database(spark, d)
    base.sql("CREATE TABLE debtors (c_custkey bigint PRIMARY KEY, c_name text NOT NULL)")
    seen = base.sql("WITH gone AS (DELETE FROM customer WHERE c_acctbal < 0 RETURNING c_custkey, c_name), put AS (INSERT INTO debtors SELECT c_custkey, c_name FROM gone RETURNING c_custkey) SELECT 'seen' AS place, count(*) AS n, CAST(sum(c_custkey) AS bigint) AS total FROM customer")
    rest = base.sql("SELECT 'new' AS place, count(*) AS n, CAST(sum(c_custkey) AS bigint) AS total FROM debtors UNION ALL SELECT 'old', count(*), CAST(sum(c_custkey) AS bigint) FROM customer")
    return seen.unionByName(rest)


@query(f"""
    SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 1 THEN c_acctbal + 10 ELSE c_acctbal END::DECIMAL(18,2) AS c_acctbal FROM {_C} WHERE c_nationkey <> 2
    UNION ALL SELECT c_custkey + 1000000, c_name, NULL, 0 FROM {_C} WHERE c_nationkey = 3""")
def statement_merge(spark, d):
    base = _database(spark, d)
    base.sql("SELECT CASE WHEN c_nationkey = 3 THEN c_custkey + 1000000 ELSE c_custkey END AS id, c_name AS name, c_nationkey AS nation INTO staged FROM customer WHERE c_nationkey IN (1, 2, 3)")
    base.sql("""
        MERGE INTO customer AS c USING staged AS s ON c.c_custkey = s.id
        WHEN MATCHED AND s.nation = 2 THEN DELETE
        WHEN MATCHED THEN UPDATE SET c_acctbal = c.c_acctbal + 10
        WHEN NOT MATCHED THEN INSERT (c_custkey, c_name, c_acctbal) VALUES (s.id, s.name, 0)""")
    return base.sql("SELECT * FROM customer")


@query("SELECT 0::BIGINT AS n, 1::BIGINT AS added")
def statement_truncate(spark, d):
    base = _database(spark, d)
    base.sql("TRUNCATE TABLE customer")
    empty = base.sql("SELECT count(*) AS n FROM customer")
    base.sql("INSERT INTO customer VALUES (1, 'one', 2, 3.5)")
    return empty.crossJoin(base.sql("SELECT count(*) AS added FROM customer WHERE c_acctbal = 3.5"))


# Constraints


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return dml.unique_violations(load(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def foreign_key_violations(spark, d):
    parent = load(spark, d, "customer").filter("c_nationkey < 20")
    return dml.foreign_key_violations(load(spark, d, "orders"), parent, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE NOT (p_size BETWEEN 5 AND 45)")
def check_violations(spark, d):
    return dml.check_violations(load(spark, d, "part"), F.col("p_size").between(5, 45)).select("p_partkey", "p_size")


@query("""
    SELECT b.o_orderkey FROM (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e FROM orders) b
    WHERE EXISTS (SELECT 1 FROM (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e FROM orders) a
                  WHERE a.o_custkey = b.o_custkey AND (a.s < b.s OR a.s = b.s AND a.o_orderkey < b.o_orderkey) AND b.s < a.e)""")
def overlap_violations(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("e"))
    return dml.overlap_violations(o, ["o_custkey"], "s", "e", ["o_orderkey"]).select("o_orderkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) * 10 AS id FROM customer WHERE c_nationkey = 1")
def identity_column(spark, d):
    rows = load(spark, d, "customer").filter("c_nationkey = 1").select("c_custkey").orderBy("c_custkey")
    return dml.with_identity(rows, "id", 10, 10)


@query("SELECT p_partkey, p_size * p_size AS square, 'none' AS note FROM part")
def generated_columns(spark, d):
    rows = dml.with_defaults(load(spark, d, "part").select("p_partkey", "p_size"), {"note": F.lit("none")})
    return dml.with_generated(rows, {"square": F.col("p_size") * F.col("p_size")}).drop("p_size")


@query("SELECT c_custkey FROM customer WHERE (c_nationkey = 1 OR c_acctbal > 9000) AND c_mktsegment <> 'BUILDING'")
def row_policies(spark, d):
    return dml.with_policy(load(spark, d, "customer"), F.col("c_nationkey") == 1, F.col("c_acctbal") > 9000, restrictive=[F.col("c_mktsegment") != "BUILDING"]).select("c_custkey")


# Version control


def _history(spark, d) -> VersionStore:
    """Three commits of a table of nations on main, and a branch off the second."""
    store = VersionStore(spark, scratch(spark, "versions"))
    nation = load(spark, d, "nation")
    store.put("nation", nation.filter("n_nationkey < 20"), ["n_nationkey"])
    store.commit("first")
    store.put("nation", nation)
    store.commit("second")
    store.branch("side")
    store.put("nation", nation.filter("n_nationkey <> 3").withColumn("n_name", F.when(F.col("n_nationkey") == 5, "FIVE").otherwise(F.col("n_name"))))
    store.commit("third")
    store.checkout("side")
    store.put("nation", nation.withColumn("n_regionkey", F.when(F.col("n_nationkey").isin(5, 7), 0).otherwise(F.col("n_regionkey"))))
    store.commit("aside")
    store.checkout("main")
    return store


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def as_of_scan(spark, d):
    return _history(spark, d).table("nation", "HEAD~2").select("n_nationkey", "n_name")


@query("SELECT 'removed' AS diff_type, 3 AS k, n_name AS before, NULL AS after FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'modified', 5, n_name, 'FIVE' FROM nation WHERE n_nationkey = 5")
def version_diff(spark, d):
    diff = _history(spark, d).diff("nation", "HEAD^", "HEAD")
    return diff.select("diff_type", F.coalesce("from_n_nationkey", "to_n_nationkey").alias("k"), F.col("from_n_name").alias("before"), F.col("to_n_name").alias("after"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'FIVE' ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (5, 7) THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 3")
def version_merge(spark, d):
    store = _history(spark, d)
    store.merge("side")
    return store.table("nation")


@query("SELECT * FROM (VALUES (0, 'third'), (1, 'second'), (2, 'first')) t(commit_order, message)")
def version_log(spark, d):
    return _history(spark, d).log().select("commit_order", "message")


@query("SELECT 'nation' AS from_table_name, 'nation' AS to_table_name, 'modified' AS diff_type, true AS data_change, false AS schema_change")
def version_diff_summary(spark, d):
    return _history(spark, d).diff_summary("HEAD~2", "HEAD")


@query("SELECT * FROM (VALUES ('main', 'third'), ('side', 'aside')) t(name, latest_commit_message)")
def version_branches(spark, d):
    return _history(spark, d).branch_table().select("name", "latest_commit_message")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def version_revert(spark, d):
    store = _history(spark, d)
    store.revert("HEAD")
    return store.table("nation").select("n_nationkey", "n_name", "n_regionkey")


_MERGED = "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 'FIVE' ELSE n_name END AS n_name, CASE WHEN n_nationkey IN (5, 7) THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 3"


@query(_MERGED)
def version_cherry_pick(spark, d):
    store = _history(spark, d)
    store.cherry_pick("side")
    return store.table("nation")


@query(f"SELECT n.*, m.message FROM ({_MERGED}) n, (VALUES ('aside')) m(message) WHERE n_nationkey IN (5, 7, 8)")
def version_rebase(spark, d):
    store = _history(spark, d)
    store.checkout("side")
    store.rebase("main")
    return store.table("nation").filter("n_nationkey IN (5, 7, 8)").crossJoin(store.log().filter("commit_order = 0").select("message"))


@query("SELECT 'aside' AS state, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'back', count(*) FROM nation WHERE n_nationkey < 10 AND n_nationkey <> 3 UNION ALL SELECT 'status', 1")
def version_stash(spark, d):
    store = _history(spark, d)
    store.put("nation", store.table("nation").filter("n_nationkey < 10"))
    changed = store.status().filter("table_name = 'nation' AND status = 'modified'").agg(F.lit("status").alias("state"), F.count("*").alias("n"))
    store.stash()
    aside = store.table("nation").agg(F.lit("aside").alias("state"), F.count("*").alias("n"))
    store.stash_pop()
    return aside.unionByName(store.table("nation").agg(F.lit("back").alias("state"), F.count("*").alias("n"))).unionByName(changed)


@query("SELECT 'reset' AS state, n_nationkey, n_name FROM nation UNION ALL SELECT 'tagged', n_nationkey, n_name FROM nation WHERE n_nationkey < 20")
def version_reset_and_tag(spark, d):
    store = _history(spark, d)
    store.tag("v1", "HEAD~2")
    store.reset("HEAD~1", hard=True)
    rows = lambda state, df: df.select(F.lit(state).alias("state"), "n_nationkey", "n_name")
    return rows("reset", store.table("nation")).unionByName(rows("tagged", store.table("nation", "v1")))


@query("""SELECT 'foreign key' AS violation_type, 'customer' AS "table", '{"c_nationkey":3}' AS "row" FROM customer WHERE c_nationkey = 3""")
def version_constraint_violations(spark, d):
    store = VersionStore(spark, scratch(spark, "versions"))
    store.put("nation", load(spark, d, "nation").filter("n_nationkey <> 3"), ["n_nationkey"])
    store.put("customer", load(spark, d, "customer").select("c_custkey", "c_nationkey"), ["c_custkey"])
    return store.constraint_violations([("customer", {"c_nationkey": "n_nationkey"}, "nation")])


@query("""
    SELECT 'side' AS state, count(*) AS n, max(n_name) AS name FROM nation WHERE n_nationkey >= 5
    UNION ALL SELECT 'merged', count(*) + 1, 'ZZ' FROM nation WHERE n_nationkey >= 5
    UNION ALL SELECT 'old', count(*), max(n_name) FROM nation
    UNION ALL SELECT 'reset', count(*), max(n_name) FROM nation WHERE n_nationkey >= 5""")
def version_statements(spark, d):
    """Statements on a versioned table, with its procedures."""
    from brindle.plans.statements import VersionedDatabase

    store = VersionStore(spark, scratch(spark, "versions"))
    store.put("nation", load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])
    base = VersionedDatabase(spark, store)
    count = lambda state, ref="": base.sql(f"SELECT '{state}' AS state, count(*) AS n, max(n_name) AS name FROM nation{ref}")
    base.sql("CALL commit('-m', 'first')")
    base.sql("CALL checkout('-b', 'side')")
    base.sql("DELETE FROM nation WHERE n_nationkey < 5")
    base.sql("CALL commit('-am', 'fewer')")
    side = count("side")
    base.sql("CALL checkout('main')")
    base.sql("INSERT INTO nation VALUES (100, 'ZZ', 1)")
    base.sql("CALL commit('-am', 'one more')")
    base.sql("CALL merge('side')")
    parts = [side, count("merged"), count("old", " AS OF 'HEAD~2'")]
    base.sql("CALL reset('--hard', 'side')")
    out = [*parts, count("reset")]
    base.close()
    return reduce(DataFrame.unionByName, out)


@query("SELECT c_custkey, c_acctbal::DECIMAL(18,2) * 2 AS ours, c_acctbal::DECIMAL(18,2) * 3 AS theirs FROM customer WHERE c_custkey % 6 = 0 AND c_acctbal <> 0")
def merge_conflicts(spark, d):
    c = _customers(spark, d)
    change = lambda n, f: c.withColumn("c_acctbal", F.when(F.col("c_custkey") % n == 0, (F.col("c_acctbal") * f).cast("decimal(18,2)")).otherwise(F.col("c_acctbal")))
    _, conflicts = merge_tables(c, change(2, 2), change(3, 3), ["c_custkey"])
    return conflicts.select(F.col("base_c_custkey").alias("c_custkey"), F.col("our_c_acctbal").alias("ours"), F.col("their_c_acctbal").alias("theirs"))


@query("SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'removed' ELSE 'modified' END AS diff_type FROM part WHERE p_size > 25 OR p_size % 2 = 0")
def table_diff(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_size")
    new = part.filter("p_size <= 25").withColumn("p_size", F.when(F.col("p_size") % 2 == 0, -F.col("p_size")).otherwise(F.col("p_size")))
    return diff_tables(part, new, ["p_partkey"]).select(F.col("from_p_partkey").alias("k"), "diff_type")


# COPY


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '' ELSE p_brand || ',\"' || chr(10) || 'x' END AS note, p_size FROM part")
def copy_csv_round_trip(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 5 == 1, "").otherwise(F.concat("p_brand", F.lit(',"\nx'))).alias("note"), "p_size")
    path = scratch(spark, "csv")
    copy.copy_to(part, path, format="csv")
    return copy.copy_from(spark, path, part.schema, format="csv")


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand || chr(9) || '\\' || chr(10) || 'x' END AS note, p_retailprice FROM part")
def copy_text_round_trip(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, F.concat("p_brand", F.lit("\t\\\nx"))).alias("note"), "p_retailprice")
    path = scratch(spark, "text")
    copy.copy_to(part, path)
    return copy.copy_from(spark, path, part.schema)


@query("SELECT p_partkey, p_size FROM part WHERE p_size % 7 <> 0")
def copy_on_error_ignore(spark, d):
    part = load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 == 0, "bad").otherwise(F.col("p_size").cast("string")).alias("p_size"))
    path = scratch(spark, "errors")
    copy.copy_to(part, path, format="csv")
    return copy.copy_from(spark, path, "p_partkey long, p_size int", format="csv", on_error="ignore", line_ends=False)


# Change streams


@query(f"SELECT c_custkey, c_name, c_nationkey, (CASE WHEN c_custkey % 4 = 2 THEN 5 ELSE c_acctbal END)::DECIMAL(18,2) AS c_acctbal FROM {_C} WHERE c_custkey % 4 <> 0")
def change_apply(spark, d):
    c = _customers(spark, d)
    log = c.filter("c_custkey % 2 = 0").select(F.when(F.col("c_custkey") % 4 == 0, "delete").otherwise("update").alias("op"), F.lit(2).cast("long").alias("lsn"), "c_custkey", "c_name", "c_nationkey", F.lit(5).cast("decimal(18,2)").alias("c_acctbal"))
    # an older change of the same rows doesn't count
    older = log.withColumn("lsn", F.lit(1).cast("long")).withColumn("op", F.lit("update")).withColumn("c_acctbal", F.lit(9).cast("decimal(18,2)"))
    return changes.apply(c, log.unionByName(older), ["c_custkey"])


@query(f"SELECT CASE WHEN c_custkey % 2 = 0 THEN 'update' ELSE 'delete' END AS op, c_custkey FROM {_C} WHERE c_custkey % 3 = 0")
def change_capture(spark, d):
    c = _customers(spark, d)
    new = c.filter("NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 1)").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "changed").otherwise(F.col("c_name")))
    return changes.capture(c, new, ["c_custkey"], 7).select("op", "c_custkey")


@query("SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,4))) AS total FROM events GROUP BY event_type")
def stream_aggregate(spark, d):
    """The same rows as a batch would give, from a stream read to its end."""
    static = load(spark, d, "events")
    schema = static.schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    path = scratch(spark, "stream")
    job = out.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/out")).trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{path}/out")


# Functions that users define


@query("SELECT p_partkey, p_size * 2 + 1 AS odd FROM part")
def sql_function(spark, d):
    from brindle.functions import user

    user.create_function(spark, "odd_of", "n INT", "INT", "n * 2 + 1")
    return load(spark, d, "part").select("p_partkey", F.expr("odd_of(p_size)").alias("odd"))


@query("SELECT n_nationkey, upper(n_name) || '!' AS loud FROM nation")
def scalar_function(spark, d):
    from brindle.functions import user

    loud = user.create_scalar(spark, "loud", lambda s: s.str.upper() + "!", "string")
    return load(spark, d, "nation").select("n_nationkey", loud("n_name").alias("loud"))


@query("SELECT n_regionkey, sum(n_nationkey * n_nationkey)::BIGINT AS squares, string_agg(n_name, '>' ORDER BY n_name) AS chain FROM nation GROUP BY n_regionkey")
def user_aggregate(spark, d):
    from brindle.functions import user

    squares = user.create_aggregate(lambda s, x: s + x.cast("long") * x, F.lit(0).cast("long"))
    chain = user.create_aggregate(lambda s, x: F.when(s == "", x).otherwise(F.concat(s, F.lit(">"), x)), F.lit(""))
    return load(spark, d, "nation").groupBy("n_regionkey").agg(squares("n_nationkey").alias("squares"), chain("n_name", "n_name").alias("chain"))


@query("SELECT o_orderpriority, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_orderpriority")
def combining_aggregate(spark, d):
    from brindle.functions import user

    return user.create_combining_aggregate(
        load(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", lambda s, x: [min(s[0], x), max(s[1], x)], lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], [float("inf"), float("-inf")], "array<double>", "spread"
    ).select("o_orderpriority", (F.col("spread")[1] - F.col("spread")[0]).alias("spread"))


@query("SELECT n_nationkey, unnest(generate_series(0, n_nationkey % 3)) AS k FROM nation")
def table_function(spark, d):
    from brindle.functions import user

    user.create_table_function(spark, "counted", lambda n: ((i,) for i in range(n % 3 + 1)), "k: int")
    load(spark, d, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, k FROM nation, LATERAL counted(n_nationkey)")


@query("SELECT c_mktsegment, count(*) AS n, 34::BIGINT AS fibonacci FROM customer WHERE c_acctbal > 34 GROUP BY c_mktsegment")
def procedural_function(spark, d):
    """A body with loops computes a bound, another returns the rows of a query with it."""
    from brindle.plans.procedural import Routines

    load(spark, d, "customer").createOrReplaceTempView("customer")
    r = Routines(spark)
    r.create("""
        CREATE FUNCTION fibonacci(n int) RETURNS bigint AS $$
        DECLARE a bigint := 0; b bigint := 1; c bigint;
        BEGIN
            IF n < 0 THEN RAISE EXCEPTION 'no number %', n; END IF;
            FOR i IN 1..n LOOP c := a + b; a := b; b := c; END LOOP;
            RETURN a;
        END $$ LANGUAGE plpgsql""")
    r.create("""
        CREATE FUNCTION over(least bigint) RETURNS TABLE (c_mktsegment text, n bigint, fibonacci bigint) AS $$
        BEGIN RETURN QUERY SELECT c_mktsegment, count(*) AS n, least AS fibonacci FROM customer WHERE c_acctbal > least GROUP BY c_mktsegment; END
        $$ LANGUAGE plpgsql""")
    return r.call("over", r.call("fibonacci", 9))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def procedure_call(spark, d):
    from brindle.functions import user

    load(spark, d, "customer").createOrReplaceTempView("customer")
    procedures = user.Procedures(spark)
    procedures.create("rich", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > :least GROUP BY 1")
    return procedures.call("rich", least=5000)


# Storage


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def partitioned_table(spark, d):
    path = scratch(spark, "partitioned")
    load(spark, d, "orders").repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    # the filter on the partition column picks folders, the other one goes to the scan
    return spark.read.parquet(path).filter("o_orderstatus = 'P' AND o_totalprice > 100000").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def inherited_tables(spark, d):
    from brindle.operators.relational import inherited_scan

    parent = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    child = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    return inherited_scan(parent, child)


@query("SELECT event_id FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') IN ('1', '1.0') AND json_type(props, '$.k') <> 'VARCHAR'")
def json_token_index(spark, d):
    """Containment by a token index: postings of all wanted keys and values are intersected, the documents rechecked."""
    from brindle.operators import jsonindex

    doc = F.to_json(F.struct("event_type", F.try_parse_json("props").alias("props")))
    docs = load(spark, d, "events").select("event_id", doc.alias("doc"))
    index = jsonindex.token_index(docs, "event_id", "doc")
    return jsonindex.containing(docs, index, "event_id", "doc", '{"event_type": "click", "props": {"k": 1}}').select("event_id")


@query("SELECT c_custkey, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer WHERE c_nationkey = 4")
def create_table_as(spark, d):
    path = scratch(spark, "ctas")
    load(spark, d, "customer").filter("c_nationkey = 4").select("c_custkey", F.col("c_acctbal").cast("decimal(18,2)").alias("c_acctbal")).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 120000")
def partial_index_scan(spark, d):
    from brindle.operators.relational import partial_index

    # the index has the rows that are partly shipped, in order of price
    index = partial_index(load(spark, d, "orders"), F.col("o_orderstatus") == "P", ["o_totalprice"], ["o_orderkey", "o_custkey"])
    return index.filter("o_totalprice > 120000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand || ',' || p_type END AS label, p_size FROM part WHERE p_size > 30")
def foreign_table_scan(spark, d):
    from brindle.sources.foreign import ForeignTables

    path = scratch(spark, "foreign")
    label = F.when(F.col("p_size") % 9 != 0, F.concat("p_brand", F.lit(","), "p_type"))
    load(spark, d, "part").select("p_partkey", label.alias("label"), "p_size").write.option("header", "true").csv(path)
    foreign = ForeignTables(spark)
    foreign.sql("CREATE SERVER files FOREIGN DATA WRAPPER file_fdw OPTIONS (header 'true')")
    foreign.sql(f"CREATE FOREIGN TABLE outside (p_partkey bigint NOT NULL, label text, p_size int) SERVER files OPTIONS (filename '{path}', format 'csv')")
    return spark.sql("SELECT * FROM outside WHERE p_size > 30")


@query("SELECT * FROM (VALUES ('select', 'R'), ('from', 'R'), ('where', 'R')) t(word, catcode)")
def catalog_keywords(spark, d):
    from brindle.sources import catalog

    # words that any SQL reserves; how others count is up to the parser
    return catalog.keywords(spark).filter("word IN ('select', 'from', 'where')").withColumn("catcode", F.lit("R"))


@query("SELECT c_custkey, upper(c_name) || '-' || c_nationkey AS c_name, c_nationkey, greatest(c_acctbal, 0)::DECIMAL(18,2) AS c_acctbal FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(18,2) AS c_acctbal FROM customer)")
def row_triggers(spark, d):
    """Triggers of each row run in the order of their names, each on what the one before made."""

    def a_upper(rows):
        return rows.withColumn("c_name", F.upper("c_name"))

    def b_label(rows):
        return rows.withColumn("c_name", F.concat("c_name", F.lit("-"), F.col("c_nationkey").cast("string")))

    def c_floor(rows):
        return rows.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0).cast("decimal(18,2)")))

    return dml.on_each_row(_customers(spark, d), c_floor, b_label, a_upper)


@query("SELECT 2 AS n, o_orderkey AS lsn FROM orders WHERE o_orderkey > 50 AND o_orderkey <= 80")
def slot_survives_restart(spark, d):
    """A slot that one process confirms is read on by another, which has its folder only."""
    path = scratch(spark, "slots")
    log = load(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("lsn")).filter("lsn <= 80")
    first = changes.Slots(spark, path)
    first.create("reader")
    first.confirm("reader", 50)
    channel = changes.Channels(spark, path)
    listener = channel.listen("orders")
    for payload in ("a", "a"):
        changes.Channels(spark, path).notify("orders", payload)
    n = len(listener.poll())
    return changes.Slots(spark, path).read("reader", log).select(F.lit(n).alias("n"), "lsn")
