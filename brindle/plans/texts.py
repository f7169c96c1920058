"""Queries in the dialect itself, as users write them.  DuckDB reads the same texts."""

from __future__ import annotations

from brindle.plans.dialect import PgSession
from brindle.plans.registry import query
from brindle.session import register

TEXTS = {
    "regex_operators": "SELECT o_orderkey, o_totalprice::numeric(18,2) AS p FROM orders WHERE o_orderpriority ~ '^[12]-' AND o_orderpriority !~* 'HIGH' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "json_operators": "SELECT event_id, props ->> 'k' AS v, (props -> 'k') IS NULL AS missing FROM events",
    "ordered_aggregates": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey), '-') AS ks FROM nation GROUP BY n_regionkey",
    "date_parts": "SELECT extract(dow FROM o_orderdate) AS d, extract(year FROM o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY 1, 2",
    "text_functions": "SELECT n_nationkey, left(n_name, -2) AS a, right(n_name, 2) AS b, substr(n_name, 2) AS c, substring(n_name, 1, 3) AS e, concat(n_name, NULL, '!') AS f, strpos(n_name, 'A') AS g, regexp_replace(n_name, '[AEIOU]', '_') AS h, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS i FROM nation",
    "series": "SELECT g.i, g.i * 2 AS twice FROM generate_series(1, 100, 3) AS g(i)",
    "lateral_unnest": "SELECT n.n_nationkey, u.w FROM nation n, unnest(string_to_array(n.n_name, '_')) AS u(w)",
    "offset_fetch": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_name NOT ILIKE '%99%' ORDER BY c_acctbal DESC, c_custkey OFFSET 3 ROWS FETCH FIRST 5 ROWS ONLY",
    "within_group": "SELECT o_orderpriority, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median FROM orders GROUP BY o_orderpriority",
    "windows": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders",
    "lateral_join": "SELECT c.c_custkey, x.total FROM customer c LEFT JOIN LATERAL (SELECT sum(o.o_totalprice::numeric(18,2)) AS total FROM orders o WHERE o.o_custkey = c.c_custkey) x ON true",
    "any_array": "SELECT n_nationkey, n_nationkey <> ALL (ARRAY[3, 4]) AS other FROM nation WHERE n_name LIKE 'N%' OR n_nationkey = ANY (ARRAY[3, 4])",
    "any_subquery": "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT s_acctbal FROM supplier) OR c_nationkey = ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)",
    "intervals": "SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice::numeric(18,2)) AS s FROM orders WHERE o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '1996-01-01' + interval '3 months' GROUP BY 1",
    "case_having": "SELECT CASE WHEN c_acctbal < 0 THEN 'neg' ELSE 'pos' END AS k, bool_and(c_acctbal > -2000) AS b, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    "row_values": "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) IN (SELECT r_regionkey, 3 FROM region) OR n_name IS NOT DISTINCT FROM 'NATION_7'",
    "recursion": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, n * n AS square FROM t",
    "quoted_names": "SELECT \"n_name\" AS \"Name\", 'it''s' AS s, E'a\\tb' AS e, $$a 'quoted' text$$ AS d FROM nation",
    "natural_join": "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) a NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) b",
    "lateral_limit": "SELECT c.c_custkey, x.o_orderkey FROM customer c CROSS JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 3) x",
    "theta_join": "SELECT s_suppkey, r_name FROM supplier JOIN region ON s_acctbal > r_regionkey * 1500",
    "set_operations": "(SELECT n_nationkey AS k FROM nation WHERE n_regionkey < 3) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
}


#: Texts that DuckDB writes otherwise.
OTHERS = {
    "between_symmetric": ("SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 10", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20"),
    "sample_all": ("SELECT c_custkey, c_name FROM customer TABLESAMPLE SYSTEM (100)", "SELECT c_custkey, c_name FROM customer"),
    "locking_clause": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 FOR UPDATE OF customer SKIP LOCKED", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3"),
    "order_by_using": ("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal USING >, c_custkey USING < LIMIT 7", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7"),
    "json_table": (
        """SELECT n_nationkey, j.place, j.word, j.size, j.odd FROM (SELECT n_nationkey, concat('{"words": [{"w": "', replace(n_name, '_', '", "n": 7}, {"w": "'), '"}]}') AS doc FROM nation) t,
        JSON_TABLE(t.doc, '$.words[*]' COLUMNS (place FOR ORDINALITY, word text PATH '$.w', size int PATH '$.n', odd boolean EXISTS PATH '$.n')) AS j""",
        """SELECT n_nationkey, i AS place, w AS word, CASE WHEN i < k THEN 7 END AS size, i < k AS odd
        FROM (SELECT n_nationkey, unnest(string_split(n_name, '_')) AS w, generate_subscripts(string_split(n_name, '_'), 1) AS i, len(string_split(n_name, '_')) AS k FROM nation)""",
    ),
}


def _runner(name: str, text: str):
    def run(spark, d):
        register(spark, d, "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
        return PgSession(spark).sql(text)

    run.__name__ = f"sql_{name}"
    return run


for _name, _text in TEXTS.items():
    query(_text)(_runner(_name, _text))

for _name, (_text, _oracle) in OTHERS.items():
    query(_oracle)(_runner(_name, _text))
