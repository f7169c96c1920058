"""Where the dialect and Spark differ, and edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import arrays, datetimes, jsons, maths, strings
from brindle.functions.jsonpath import evaluate, parse_path
from brindle.operators import dml
from brindle.operators import relational as R
from brindle.operators.versions import Conflict, VersionStore, resolve_conflicts
from brindle.plans import registry
from brindle.session import scratch
from brindle.sources import catalog, copy
from brindle.streaming.changes import Slots, Subscription


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def raises(spark, column):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, column)


def test_strings(spark):
    lit = F.lit
    assert one(spark, strings.concat("a", lit(None), 1)) == "a1"
    assert one(spark, strings.left(lit("abc"), -1), strings.right(lit("abc"), -1), strings.right(lit("abc"), 0)) == ("ab", "bc", "")
    assert one(spark, strings.substr(lit("abcdef"), -1), strings.substr(lit("abcdef"), -1, 4)) == ("abcdef", "ab")
    raises(spark, strings.substr(lit("abc"), 1, -1))
    assert one(spark, strings.chr(lit(8364)), strings.ascii(lit("€"))) == ("€", 8364)
    raises(spark, strings.chr(lit(0)))
    assert one(spark, strings.regexp_replace(lit("a1b2"), r"\d", "#"), strings.regexp_replace(lit("a1b2"), r"\d", "#", "g")) == ("a#b2", "a#b#")
    assert one(spark, strings.string_to_array(lit("a,,b"), ",", "")) == ["a", None, "b"]
    assert one(spark, strings.string_to_array(lit("abc"), None)) == ["a", "b", "c"]
    assert one(spark, strings.similar_to(lit("abc"), "(a|x)%"), strings.similar_to(lit("abc"), "a")) == (True, False)
    assert one(spark, strings.regexp_match(lit("foobarbequebaz"), "(bar)(beque)")) == ["bar", "beque"]
    assert one(spark, strings.regexp_matches(lit("a1b2"), r"([a-z])(\d)", "g")) == [["a", "1"], ["b", "2"]]
    assert one(spark, strings.quote_literal(lit("a\\b'c"))) == " E'a\\\\b''c'"
    assert one(spark, strings.encode(lit(b"a\x00\xff"), "escape")) == "a\\000\\377"
    assert one(spark, strings.decode(lit("a\\000\\377"), "escape")) == b"a\x00\xff"
    assert one(spark, strings.split_part(lit("a.b.c"), ".", -1)) == "c"


def test_numbers(spark):
    assert one(spark, maths.round_double(F.lit(2.5)), maths.round(F.lit(2.5).cast("decimal(3,1)")).cast("int")) == (2.0, 3)
    raises(spark, maths.sqrt(F.lit(-1.0)))
    raises(spark, maths.ln(F.lit(0.0)))
    assert int(one(spark, maths.factorial(F.lit(25)))) == 15511210043330985984000000
    assert one(spark, maths.double_text(F.lit(1e20)), maths.double_text(F.lit(1.0)), maths.double_text(F.lit(0.5))) == ("100000000000000000000", "1", "0.5")


def test_dates(spark):
    t = F.lit("2024-02-25").cast("timestamp_ntz")
    assert one(spark, datetimes.extract("dow", t), datetimes.extract("isodow", t)) == (0, 7)
    age = datetimes.age(F.lit("2024-03-31").cast("timestamp_ntz"), F.lit("2024-02-29").cast("timestamp_ntz"))
    assert tuple(one(spark, age)) == (1, 2, 0)
    assert str(one(spark, datetimes.plus(F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"), datetimes.interval("1 mon 1 day 01:00")))) == "2024-03-01 11:00:00"


def test_arrays(spark):
    empty = F.array().cast("array<int>")
    assert one(spark, arrays.array_length(empty), arrays.array_dims(empty)) == (None, None)
    assert one(spark, arrays.array_sort(F.array(F.lit(2), F.lit(None), F.lit(1)))) == [1, 2, None]
    assert one(spark, arrays.array_sort(F.array(F.lit(2), F.lit(None), F.lit(1)), descending=True)) == [None, 2, 1]
    assert one(spark, arrays.array_position(F.array(F.lit(1), F.lit(None)), F.lit(None))) == 2


@pytest.mark.parametrize(
    ("path", "found"),
    [("$.a[*]", [1, 2, 3]), ("$.a[last]", [3]), ("$.a[0 to 1]", [1, 2]), ("$.a ? (@ >= 2)", [2, 3]), ("$.a.size()", [3]), ("$.**.x", [5]), ('$.s ? (@ starts with "ab")', ["abc"]), ("$.missing", []), ("$.a[0] + 4", [5]), ('$.s like_regex "^A" flag "i"', [True]), ("exists($.b.x) && !($.a[0] == 2)", [True])],
)
def test_jsonpath(path, found):
    doc = jsons.loads('{"a": [1, 2, 3], "b": {"x": 5}, "s": "abc"}')
    assert [float(x) if not isinstance(x, (bool, str)) else x for x in evaluate(parse_path(path), doc)] == found


def test_null_order_and_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 1)], "id int, x int")
    assert [r.id for r in df.orderBy(R.asc("x"), "id").collect()] == [4, 1, 3, 2]
    assert [r.id for r in df.orderBy(R.desc("x"), "id").collect()] == [2, 1, 3, 4]
    assert sorted(r.id for r in R.with_ties(df, 2, [R.asc("x")]).collect()) == [1, 3, 4]
    assert R.with_ties(df, 0, [R.asc("x")]).count() == 0


def test_not_in_with_nulls(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some = spark.createDataFrame([(1,), (None,)], "v int")
    assert R.not_in(df, "a", some, "v").count() == 0
    assert R.not_in(df, "a", some.filter("v = 1"), "v").collect()[0].a == 2
    assert R.not_in(df, "a", some.limit(0), "v").count() == 3


def test_distinct_on_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    assert sorted(r.v for r in R.distinct_on(df, ["k"], [R.asc("v")]).collect()) == [1, 3]


def test_array_agg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, x string")
    row = df.agg(R.array_agg("x", ["i"]).alias("a"), R.string_agg("x", ",", ["i"]).alias("s"), R.json_agg("x", ["i"]).alias("j")).first()
    assert (row.a, row.s, row.j) == (["b", None, "a"], "b,a", '["b", null, "a"]')


def test_repeated_source_keys(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "id int, x int")
    s = spark.createDataFrame([(1, 7), (1, 5), (2, 9), (8, 1), (8, 2)], "id int, x int")
    # an update takes the first source row, and each target row once
    assert sorted(map(tuple, dml.update_from(t, s, ["id"], {"x": F.col("s.x")}).collect())) == [(1, 5), (2, 9), (2, 9), (3, 30)]
    found = dml.update_from(t, s, ["id"], {"x": F.col("s.x")}, F.col("s.x") > 5)
    assert sorted(map(tuple, found.collect())) == [(1, 7), (2, 9), (2, 9), (3, 30)]
    with pytest.raises(Exception, match="affect row a second time"):
        dml.merge(t, s, ["id"], matched=[(None, {"x": F.col("s.x")})]).collect()
    # rows that no clause touches are neither refused nor repeated
    out = dml.merge(t, s, ["id"], matched=[(F.col("s.id") == 2, {"x": F.col("s.x")})], not_matched=[(None, {"id": F.col("s.id"), "x": F.col("s.x")})])
    assert sorted(map(tuple, out.collect())) == [(1, 10), (2, 9), (2, 9), (3, 30), (8, 1), (8, 2)]


def test_returning(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "id int, x int")
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(dml.insert_returning(t, spark.createDataFrame([(9,)], "id int"))) == ["(9, None)"]
    # updated rows count even if nothing changes
    assert rows(dml.update_returning(t, {"x": F.lit(10)}, F.col("x") < 15)) == ["(1, 10)"]
    assert rows(dml.delete_returning(t, F.col("x") > 15)) == ["(2, 20)"] and dml.truncate(t).count() == 0
    new = spark.createDataFrame([(1, 5), (2, 6), (7, 8)], "id int, x int")
    assert rows(dml.upsert_returning(t, new, ["id"])) == ["(1, 5)", "(2, 6)", "(7, 8)"]
    assert rows(dml.upsert_returning(t, new, ["id"], where=F.col("t.x") > 15)) == ["(2, 6)", "(7, 8)"]


def test_identity_numbers_follow_partitions(spark):
    rows = spark.range(100).withColumn("n", F.lit("x")).repartition(7)
    got = dml.with_identity(rows, "number", 5, 5).collect()
    assert sorted(r.number for r in got) == list(range(5, 505, 5)) and {r.id for r in got} == set(range(100)) and got[0].n == "x"


def test_upsert_where_and_merge_delete(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "id int, x int")
    s = spark.createDataFrame([(2, 5), (3, 7)], "id int, x int")
    assert sorted(map(tuple, dml.upsert(t, s, ["id"]).collect())) == [(1, 10), (2, 5), (3, 7)]
    out = dml.merge(t, s, ["id"], matched=[(None, "delete")], not_matched_by_source=[(None, {"x": F.lit(0)})])
    assert sorted(map(tuple, out.collect())) == [(1, 0)]


def test_overlaps_of_periods_that_begin_together(spark, tmp_path):
    day = F.make_date(F.lit(2024), F.lit(1), F.col("day")).cast("timestamp_ntz")
    rows = [(3, 1, 10), (2, 1, 10), (1, 1, 10), (5, 1, 19), (5, 1, 19), (8, None, 10), (9, None, 10), (4, 2, 5), (4, 2, 5)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, day int").withColumn("o_orderdate", day)
    for i, order in enumerate((F.asc("o_orderkey"), F.desc("o_orderkey"))):
        orders.coalesce(1).sortWithinPartitions(order).write.parquet(f"{tmp_path}/{i}/orders.parquet")
        assert sorted(r.o_orderkey for r in registry.queries()["overlap_violations"](spark, f"{tmp_path}/{i}").collect()) == [2, 3, 5, 5]


def test_sequences():
    s = dml.Sequence_(5, 2)
    assert [s.nextval(), s.nextval(3), s.currval()] == [5, 7, 11]
    s.setval(100, called=False)
    assert s.nextval() == 100


def test_versions(spark):
    store = VersionStore(spark, scratch(spark, "store"))
    make = lambda *rows: spark.createDataFrame(list(rows), "id int, a int, b int")
    store.put("t", make((1, 1, 1), (2, 2, 2)), ["id"])
    first = store.commit("first")
    store.branch("other")
    store.put("t", make((1, 10, 1), (2, 2, 2), (3, 3, 3)))
    assert [r.status for r in store.status().collect()] == ["modified"]
    store.commit("ours")
    store.checkout("other")
    store.put("t", make((1, 1, 11), (2, 2, 2)))
    store.commit("theirs")
    store.checkout("main")
    store.merge("other")
    assert sorted(map(tuple, store.table("t").collect())) == [(1, 10, 11), (2, 2, 2), (3, 3, 3)]
    store.tag("v1", "HEAD^")
    assert store.table("t", "v1").count() == 3 and store.table("t", first).count() == 2
    assert VersionStore(spark, store.path).head == store.head
    store.revert("HEAD")
    assert sorted(map(tuple, store.table("t").collect()))[0] == (1, 10, 1)
    store.reset("HEAD~2", hard=True)
    store.branch("clash")
    store.put("t", make((1, 100, 1)))
    store.commit("change")
    store.checkout("clash")
    store.put("t", make((1, 200, 1)))
    store.commit("other change")
    store.checkout("main")
    with pytest.raises(Conflict) as caught:
        store.merge("clash")
    bad = caught.value.conflicts["t"]
    assert {(r.our_a, r.their_a) for r in bad.collect()} == {(100, 200)}
    assert resolve_conflicts(store.table("t").limit(0), bad, "theirs").first().a == 200
    store.put("t", make((9, 9, 9)))
    store.stash()
    assert store.status_names() == []
    store.stash_pop()
    assert store.status_names() == ["t"]
    assert store.gc() >= 0
    assert store.column_diff("HEAD").count() == 0


def test_copy(spark, tmp_path):
    (tmp_path / "a.csv").write_text('pk,c1\n1,"two\nlines"\n2,""\n3,\n4,"say ""hi"""\n')
    df = copy.copy_from(spark, str(tmp_path / "a.csv"), "pk int, c1 string", format="csv", header=True)
    assert sorted(map(tuple, df.collect())) == [(1, "two\nlines"), (2, ""), (3, None), (4, 'say "hi"')]
    (tmp_path / "b.csv").write_text("1,x\nbad,y\n3,z\n")
    path = str(tmp_path / "b.csv")
    with pytest.raises(Exception):  # noqa: B017
        copy.copy_from(spark, path, "a int, b string", format="csv").collect()
    assert copy.copy_from(spark, path, "a int, b string", format="csv", on_error="ignore").count() == 2
    assert copy.rejected(spark, path, "a int, b string").count() == 1
    with pytest.raises(ValueError):
        copy.copy_from(spark, path, "a int, b string", format="csv", on_error="ignore", reject_limit=0)
    rows = [(1, "a", None, 2.5), (2, None, True, -1.0)]
    (tmp_path / "c.bin").write_bytes(copy.pack_rows(rows, ["int", "string", "boolean", "double"]))
    back = copy.copy_from(spark, str(tmp_path / "c.bin"), "a int, b string, c boolean, d double", format="binary")
    assert sorted(map(tuple, back.collect())) == rows


def test_subscription(spark, tmp_path):
    store = VersionStore(spark, scratch(spark, "sub"))
    store.put("t", spark.createDataFrame([(1, 1)], "id int, x int"), ["id"])
    store.commit("first")
    sub = Subscription(store, "t", ["id"])
    log = spark.createDataFrame([("insert", 1, 2, 2), ("update", 2, 1, 9), ("delete", 3, 2, 2), ("insert", 4, 3, 3)], "op string, lsn long, id int, x int")
    log.coalesce(1).write.json(str(tmp_path / "log"))
    job = sub.start(spark.readStream.schema(log.schema).json(str(tmp_path / "log")), str(tmp_path / "check"))
    job.awaitTermination()
    assert sorted(map(tuple, store.table("t").collect())) == [(1, 9), (3, 3)]
    sub.apply_batch(log)
    assert sub.position() == 4 and sorted(map(tuple, store.table("t").collect())) == [(1, 9), (3, 3)]
    slots = Slots()
    slots.create("s")
    slots.confirm("s", 2)
    assert [r.lsn for r in slots.read("s", log).collect()] == [3, 4]


def test_catalog(spark):
    spark.createDataFrame([(1, ["a"])], "id int, tags array<string>").createOrReplaceTempView("catalogued")
    assert [(r.column_name, r.data_type) for r in catalog.columns(spark, "catalogued").collect()] == [("id", "integer"), ("tags", "ARRAY")]


def test_dialect(spark, tmp_path):
    from brindle.plans.dialect import PgSession

    store = VersionStore(spark, scratch(spark, "dialect"))
    store.put("t", spark.createDataFrame([(1, "a")], "id int, x string"), ["id"])
    store.commit("first")
    store.put("t", spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, x string"))
    store.commit("second")
    pg = PgSession(spark, store)
    assert pg.sql("SELECT count(*) FROM t AS OF 'HEAD~1'").first()[0] == 1
    assert [r.id for r in pg.sql("SELECT id FROM t ORDER BY x DESC").collect()] == [2, 3, 1]
    assert [r.id for r in pg.sql("SELECT id FROM t WHERE id > $1 AND x = $2 FOR UPDATE", 1, "c").collect()] == [3]
    assert tuple(pg.sql("SELECT 7/2, 2^3, (ARRAY[1,2,3])[2], (ARRAY[1,2,3])[2:3], chr(8364), '{\"a\":{\"b\":5}}'::jsonb #>> '{a,b}'").first()) == (3, 8.0, 2, [2, 3], "€", "5")
    assert tuple(pg.sql("SELECT 'abc' SIMILAR TO 'a(b|x)%', 'abc' NOT SIMILAR TO 'a', ARRAY[1,2] && ARRAY[2], ARRAY[1,2] @> ARRAY[3]").first()) == (True, True, True, False)
    rows = pg.sql("SELECT id, x FROM (VALUES (1, 5), (2, 5), (3, 4)) v(id, x) ORDER BY x DESC FETCH FIRST 1 ROW WITH TIES").collect()
    assert sorted(r.id for r in rows) == [1, 2]
    assert pg.sql("SELECT to_char(timestamp '2024-03-05', 'DD Mon YYYY'), rank(4) WITHIN GROUP (ORDER BY id) FROM t").first()[0] == "05 Mar 2024"
    with pytest.raises(ValueError):
        pg.translate("SELECT * FROM t TABLESAMPLE SYSTEM (10)")
    with pytest.raises(ValueError):
        pg.translate("SELECT sum(id) OVER (ORDER BY id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t")


def test_correlated_limits_number_rows_in_their_order(spark):
    """The sort of a correlated query must reach the window that Spark makes of its limit."""
    from brindle.plans.dialect import PgSession

    spark.createDataFrame([(1,), (2,), (3,)], "k long").createOrReplaceTempView("lat_c")
    rows = [(1, 10, 5, 1), (1, 11, 7, 1), (1, 12, 7, 2), (1, 13, None, 2), (2, 20, 1, 1), (2, 21, 2, 1), (2, 22, 2, 1)]
    spark.createDataFrame(rows, "k long, v long, w long, g long").createOrReplaceTempView("lat_t")
    pg = PgSession(spark)
    lateral = "SELECT c.k, x.* FROM lat_c c CROSS JOIN LATERAL ({}) x"
    for text, found in [
        (lateral.format("SELECT t.v FROM lat_t t WHERE t.k = c.k ORDER BY t.w DESC, t.v LIMIT 2"), [(1, 11), (1, 13), (2, 21), (2, 22)]),
        (lateral.format("SELECT t.v AS w FROM lat_t t WHERE t.k = c.k ORDER BY t.w, w DESC OFFSET 1 ROWS FETCH FIRST 2 ROWS ONLY"), [(1, 11), (1, 12), (2, 21), (2, 22)]),
        (lateral.format("SELECT t.g FROM lat_t t WHERE t.k = c.k GROUP BY t.g ORDER BY max(t.v) DESC LIMIT 1"), [(1, 2), (2, 1)]),
        (lateral.format("SELECT DISTINCT ON (t.g) t.v FROM lat_t t WHERE t.k = c.k ORDER BY t.g DESC, t.w, t.v LIMIT 1"), [(1, 12), (2, 20)]),
        ("SELECT c.k, (SELECT t.v FROM lat_t t WHERE t.k = c.k ORDER BY t.w DESC NULLS LAST, t.v DESC LIMIT 1) AS v FROM lat_c c", [(1, 12), (2, 22), (3, None)]),
    ]:
        df = pg.sql(text)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        cut = [w.split("specifiedwindowframe")[0] for w in plan.split("row_number() windowspecdefinition(")[1:]]
        assert all(" ASC " in w or " DESC " in w for w in cut), text
        assert len(df.columns) == 2 and sorted(map(tuple, df.collect())) == found, text


def test_set_returning_functions(spark):
    df = spark.createDataFrame([(1, '[{"a": 1, "b": "x"}, {"a": 2}]', '{"k": 1, "m": null}', "p,q")], "id int, doc string, obj string, t string")
    assert [r.value for r in R.json_array_elements(df, "doc").collect()] == ['{"a": 1, "b": "x"}', '{"a": 2}']
    assert [(r.key, r.value) for r in R.json_each(df, "obj", text=True).collect()] == [("k", "1"), ("m", None)]
    assert [(r.a, r.b) for r in R.json_to_recordset(df, "doc", "a: int, b: string").collect()] == [(1, "x"), (2, None)]
    assert [(r.n, r.s) for r in R.json_table(df, "doc", "$[*]", {"n": ("int", "$.a"), "s": ("string", "$.b")}).collect()] == [(1, "x"), (2, None)]
    assert [r.part for r in R.string_to_table(df, "t", ",").collect()] == ["p", "q"] == [r.part for r in R.regexp_split_to_table(df, "t", "[,;]").collect()]


def test_functions_behind_operators(spark):
    from brindle.functions.registry import function as f

    h = lambda **kv: F.create_map(*(F.lit(x) for p in kv.items() for x in p))
    assert one(spark, f("anytextcat")(1, "x"), f("hstore_lt")(h(a="1"), h(a="2")), f("hstore_ne")(h(a="1"), h(a="1")), f("vector_lt")(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == ("1x", True, False, True)
    assert one(spark, f("set_config")("app.name", "v"), f("current_setting")("app.name"), f("current_setting")("app.none", True)) == ("v", "v", None)
    with pytest.raises(ValueError, match="unrecognized"):
        f("current_setting")("app.none")
    raw = F.lit(b"some bytes" * 20)
    sealed = f("armor")(raw, {"Version": "1", "Comment": "c"})
    assert one(spark, f("dearmor")(sealed) == raw, f("pgp_armor_headers")(sealed)) == (True, {"Version": "1", "Comment": "c"})
    with pytest.raises(Exception, match="Corrupt"):
        spark.range(1).select(f("dearmor")(F.replace(sealed, F.lit("c29t"), F.lit("c29u")))).collect()
    rows = lambda c: [r[0] for r in spark.range(1).select(c).collect()]
    assert (rows(f("generate_series")(5, 1, -2)), rows(f("generate_series")(1, 0)), rows(f("string_to_table")(F.lit("a,b"), ","))) == ([5, 3, 1], [], ["a", "b"])
    assert one(spark, f("to_jsonb")(F.lit("x")), f("unicode_assigned")("ab")) == ('"x"', True)


def test_every_function_has_a_name(spark):
    from brindle.functions.registry import function, functions

    assert len(functions()) > 300
    named = "to_json to_jsonb row_to_json current_setting set_config textcat byteacat bitcat hstore_lt vector_ge uuid_ns_dns armor dearmor querytree unnest generate_series regexp_split_to_table each skeys json_array_elements"
    assert set(named.split()) <= set(functions())
    assert one(spark, function("split_part")(F.lit("a.b"), ".", 2), function("jsonb_typeof")(F.lit("[1]")), function("l2_distance")([0.0, 3.0], [4.0, 0.0])) == ("b", "array", 5.0)
    state = F.array(F.lit(0.0))
    for v in ([1.0, 2.0], [3.0, 6.0]):
        state = function("vector_accum")(state, v)
    assert one(spark, function("vector_avg")(state)) == [2.0, 4.0]
    assert one(spark, function("jsonb_to_tsvector")(F.lit('{"a": "the fat Cat"}'))) == "'cat':4 'fat':3"


def test_user_functions(spark):
    from brindle.functions import misc, user

    made = user.create_scalar(spark, "joined_twice", lambda a, b: a + b + b, "string")
    df = spark.createDataFrame([("x", "y"), (None, "y")], "a string, b string")
    assert [r[0] for r in df.select(made("a", "b")).collect()] == ["xyy", None]
    assert spark.sql("SELECT joined_twice('p', 'q')").first()[0] == "pqq"
    calls = user.Procedures(spark)
    calls.create("twice", lambda s, n: n * 2)
    assert calls.call("twice", 4) == 8
    with pytest.raises(KeyError):
        calls.call("missing")
    row = spark.range(3).select(misc.uuid_generate_v1().alias("a"), misc.uuidv7().alias("b")).select("a", "b", misc.uuid_extract_version("a").alias("v1"), misc.uuid_extract_version("b").alias("v7"), misc.uuid_extract_timestamp("b").alias("t")).collect()
    assert {(r.v1, r.v7) for r in row} == {(1, 7)} and all(r.t.year > 2000 for r in row)


def test_slots_and_channels_are_durable(spark, tmp_path):
    from brindle.streaming.changes import Channels, Slots

    path = f"file://{tmp_path}/shared"
    slots = Slots(spark, path)
    slots.create("s", 3)
    slots.confirm("s", 9)
    slots.confirm("s", 7)
    again = Slots(spark, path)
    assert again.confirmed == {"s": 9}
    with pytest.raises(ValueError, match="already exists"):
        again.create("s")
    again.drop("s")
    assert Slots(spark, path).confirmed == {}
    channels = Channels(spark, path)
    channels.notify("c", "before")
    listener = channels.listen("c")
    for payload in ("é", "", "é"):
        Channels(spark, path).notify("c", payload)
    assert listener.poll() == ["é", "", "é"] and listener.poll() == [] and channels.listen("other").poll() == []


def test_procedural_bodies(spark):
    from brindle.plans.procedural import Routines

    spark.range(6).createOrReplaceTempView("six")
    r = Routines(spark)
    r.create("""CREATE FUNCTION gauss(n int, start bigint DEFAULT 0) RETURNS bigint AS $$
        DECLARE total bigint := start; k int;
        BEGIN
            IF n < 0 THEN RAISE EXCEPTION 'negative: %', n; ELSIF n = 0 THEN RETURN total; END IF;
            FOR i IN 1..n LOOP
                CONTINUE WHEN i % 2 = 0;
                EXIT WHEN i > 7;
                total := total + i;
            END LOOP;
            RETURN total;
        END $$ LANGUAGE plpgsql""")
    assert (r.call("gauss", 4), r.call("gauss", 100), r.call("gauss", 0, 9), r.call("gauss", 3, start=10)) == (4, 16, 9, 14)
    with pytest.raises(Exception, match="negative: -1"):
        r.call("gauss", -1)
    r.create("""CREATE FUNCTION walk(most int) RETURNS text AS $$
        DECLARE n int := 0; out text := ''; biggest bigint; rec record;
        BEGIN
            <<outer>> LOOP
                n := n + 1;
                WHILE true LOOP
                    IF n >= most THEN EXIT outer; END IF;
                    EXIT;
                END LOOP;
            END LOOP;
            FOR rec IN SELECT id FROM six WHERE id > 3 ORDER BY id DESC LOOP out := out || rec.id || ','; END LOOP;
            SELECT max(id) INTO biggest FROM six;
            PERFORM id FROM six;
            CASE n WHEN 3 THEN out := out || 'three'; ELSE out := out || 'other'; END CASE;
            BEGIN
                RAISE EXCEPTION 'inner';
            EXCEPTION WHEN others THEN
                out := out || '!';
            END;
            FOR i IN REVERSE 3..1 LOOP out := out || i; END LOOP;
            RETURN out || biggest;
        END; $$ LANGUAGE plpgsql""")
    assert r.call("walk", 3) == "5,4,three!3215"
    r.create("CREATE FUNCTION above(least bigint) RETURNS TABLE (id bigint) AS $$ BEGIN RETURN QUERY SELECT id FROM six WHERE id > least; END $$ LANGUAGE plpgsql")
    assert sorted(x.id for x in r.call("above", 2).collect()) == [3, 4, 5]
    r.create("CREATE FUNCTION dyn(k int) RETURNS int AS $$ DECLARE v int; BEGIN EXECUTE 'SELECT $1 * 2' INTO v USING k; ASSERT v > 0, 'no'; RETURN v; END $$ LANGUAGE plpgsql")
    assert r.call("dyn", 21) == 42
