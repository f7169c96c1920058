"""Scalar functions, a query for each family."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import arrays as A
from brindle.functions import datetimes as D
from brindle.functions import jsons as J
from brindle.functions import maps as H
from brindle.functions import maths as M
from brindle.functions import misc as X
from brindle.functions import strings as S
from brindle.functions import textsearch as TS
from brindle.functions import vectors as V
from brindle.operators import relational as R
from brindle.plans.registry import query
from brindle.session import load


@query("""
    SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name) AS bits, octet_length(encode(p_name)) AS bytes, length(p_name) AS n, lower(p_brand) AS lo, upper(p_type) AS up,
           trim('  ' || p_brand || ' ') AS t, ltrim('xxy' || p_brand, 'xy') AS lt, rtrim(p_brand || 'zz', 'z') AS rt, concat(p_brand, NULL, '-', p_size) AS joined,
           left(p_name, 3) AS l3, left(p_name, -2) AS lm, right(p_name, 3) AS r3, right(p_name, -2) AS rm, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 3, '*') AS rp,
           md5(p_name) AS digest, repeat('ab', p_size % 3) AS rep, replace(p_name, 'a', '#') AS repl, reverse(p_name) AS rev, strpos(p_name, 'a') AS pos,
           starts_with(p_name, 'a') AS st, translate(p_name, 'abc', 'xy') AS tr, chr((p_size % 26 + 97)::INT) AS letter, split_part(p_name, ' ', 2) AS second
    FROM part""")
def string_functions(spark, d):
    n, b = F.col("p_name"), F.col("p_brand")
    return load(spark, d, "part").select(
        "p_partkey", S.ascii(n).alias("a"), S.bit_length(n).alias("bits"), S.octet_length(n).alias("bytes"), S.length(n).alias("n"), S.lower(b).alias("lo"), S.upper("p_type").alias("up"),
        S.btrim(F.concat(F.lit("  "), b, F.lit(" "))).alias("t"), S.ltrim(F.concat(F.lit("xxy"), b), "xy").alias("lt"), S.rtrim(F.concat(b, F.lit("zz")), "z").alias("rt"),
        S.concat(b, F.lit(None), "-", F.col("p_size")).alias("joined"), S.left(n, 3).alias("l3"), S.left(n, -2).alias("lm"), S.right(n, 3).alias("r3"), S.right(n, -2).alias("rm"),
        S.lpad(b, 12, "*").alias("lp"), S.rpad(b, 3, "*").alias("rp"), S.md5(n).alias("digest"), S.repeat(F.lit("ab"), F.col("p_size") % 3).alias("rep"), S.replace(n, "a", "#").alias("repl"),
        S.reverse(n).alias("rev"), S.strpos(n, "a").alias("pos"), S.starts_with(n, "a").alias("st"), S.translate(n, "abc", "xy").alias("tr"), S.chr((F.col("p_size") % 26 + 97).cast("int")).alias("letter"),
        S.split_part(n, " ", 2).alias("second"),
    )


@query(r"""
    SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS first_only, regexp_replace(p_name, '[aeiou]', '_', 'g') AS every, regexp_replace(p_name, '(\w)(\w)', '\2\1') AS swapped,
           len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_split_to_array(p_name, '\s+')[1] AS word, regexp_extract(p_name, '(\w+)$', 1) AS last_word,
           substring(p_name, 2, 4) AS middle, substr(p_name, 3) AS rest, len(string_split(p_type, ' ')) AS parts, to_base(p_size, 2) AS bin, lower(to_base(p_size * 37, 16)) AS hex, to_base(p_size, 8) AS oct,
           'it''s ' || p_size AS quoted, '#' || p_size || '|' || p_brand || '|%' AS formatted, lower(hex(encode(p_brand))) AS hexed, base64(encode(p_brand)) AS b64
    FROM part""")
def string_patterns(spark, d):
    n = F.col("p_name")
    return load(spark, d, "part").select(
        "p_partkey", S.regexp_replace(n, "[aeiou]", "_").alias("first_only"), S.regexp_replace(n, "[aeiou]", "_", "g").alias("every"), S.regexp_replace(n, r"(\w)(\w)", r"\2\1").alias("swapped"),
        S.regexp_count(n, "[aeiou]").alias("vowels"), F.get(S.regexp_split_to_array(n, r"\s+"), F.lit(0)).alias("word"), S.substring_regex(n, r"(\w+)$").alias("last_word"),
        S.substr(n, 2, 4).alias("middle"), S.substr(n, 3).alias("rest"), F.size(S.string_to_array("p_type", " ")).alias("parts"), S.to_bin("p_size").alias("bin"), S.to_hex(F.col("p_size") * 37).alias("hex"), S.to_oct("p_size").alias("oct"),
        S.format("it's %s", F.col("p_size")).alias("quoted"), S.format("#%s|%2$s|%%", F.col("p_size"), F.col("p_brand")).alias("formatted"), S.encode("p_brand", "hex").alias("hexed"), S.encode("p_brand", "base64").alias("b64"),
    )


@query("""
    SELECT * FROM (VALUES ('Hi tHOMAS', 'Hi Thomas', 'a-b c', 'A-B C', -1870292951, 'plain', '"Two Words"', 'O''Reilly', '''O''''Reilly''', true))
    t(raw, title, dashed, dashed_title, h, ident, ident2, name, literal, valid)""")
def string_quoting(spark, d):
    row = spark.sql("SELECT 'Hi tHOMAS' AS raw, 'a-b c' AS dashed, 'O\\'Reilly' AS name")
    return row.select(
        "raw", S.initcap("raw").alias("title"), "dashed", S.initcap("dashed").alias("dashed_title"), S.hashtext(F.lit("hello")).alias("h"), S.quote_ident(F.lit("plain")).alias("ident"), S.quote_ident(F.lit("Two Words")).alias("ident2"),
        "name", S.quote_literal("name").alias("literal"), (S.parse_ident(F.lit('a."B c"')) == F.array(F.lit("a"), F.lit("B c"))).alias("valid"),
    )


@query("""
    SELECT c_custkey, abs(c_acctbal) AS ab, ceil(c_acctbal) AS ce, floor(c_acctbal) AS fl, round(sqrt(abs(c_acctbal)), 6) AS sq, round(cbrt(c_acctbal), 6) AS cb, sign(c_acctbal) AS si,
           round(ln(c_custkey + 1), 9) AS l, round(log10(c_custkey + 1), 9) AS l10, round(exp(c_nationkey / 10), 6) AS ex, round(power(c_nationkey, 2.5), 4) AS po, c_custkey % 7 AS mo,
           trunc(c_acctbal) AS tr, round(c_acctbal::DECIMAL(18,2), 1)::DECIMAL(18,1) AS ro, gcd(c_custkey, 36) AS g, lcm(c_custkey, 6) AS lc, greatest(c_custkey, c_nationkey, 100) AS hi, least(c_custkey, c_nationkey, 100) AS lo,
           factorial(c_nationkey::INT)::DECIMAL(38,0) AS fa, round(lgamma(c_nationkey + 1.5), 6) AS lg, round(gamma(c_nationkey / 10 + 1.5), 6) AS ga
    FROM customer""")
def math_functions(spark, d):
    x, k, n = F.col("c_acctbal"), F.col("c_custkey"), F.col("c_nationkey")
    return load(spark, d, "customer").select(
        "c_custkey", M.abs(x).alias("ab"), M.ceil(x).cast("double").alias("ce"), M.floor(x).cast("double").alias("fl"), F.round(M.sqrt(F.abs(x)), 6).alias("sq"), F.round(M.cbrt(x), 6).alias("cb"), M.sign(x).alias("si"),
        F.round(M.ln(k + 1), 9).alias("l"), F.round(M.log(k + 1), 9).alias("l10"), F.round(M.exp(n / 10), 6).alias("ex"), F.round(M.power(n, 2.5), 4).alias("po"), M.mod(k, 7).alias("mo"),
        M.trunc(x).cast("double").alias("tr"), M.round(x.cast("decimal(18,2)"), 1).cast("decimal(18,1)").alias("ro"), M.gcd(k, 36).alias("g"), M.lcm(k, 6).alias("lc"), M.greatest(k, n, 100).alias("hi"), M.least(k, n, 100).alias("lo"),
        M.factorial(n).alias("fa"), F.round(M.lgamma(n + 1.5), 6).alias("lg"), F.round(M.gamma(n / 10 + 1.5), 6).alias("ga"),
    )


@query("""
    SELECT n_nationkey, round(sin(x), 9) AS s, round(cos(x), 9) AS c, round(tan(x), 9) AS t, round(cot(x + 0.5), 9) AS ct, round(asin(y), 9) AS as_, round(acos(y), 9) AS ac, round(atan(x), 9) AS at,
           round(atan2(y, x + 1), 9) AS at2, round(sinh(x), 9) AS sh, round(cosh(x), 9) AS ch, round(tanh(x), 9) AS th, round(asinh(x), 9) AS ash, round(acosh(x + 1), 9) AS ach, round(atanh(y / 2), 9) AS ath,
           round(degrees(x), 9) AS dg, round(radians(x), 9) AS rd, round(sin(radians(n_nationkey * 10)), 9) AS sd, round(cos(radians(n_nationkey * 10)), 9) AS cd, round(pi(), 9) AS p
    FROM (SELECT n_nationkey, n_nationkey / 10 AS x, n_nationkey / 25 AS y FROM nation)""")
def trigonometry(spark, d):
    n = load(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") / 10).alias("x"), (F.col("n_nationkey") / 25).alias("y"))
    x, y, k = F.col("x"), F.col("y"), F.col("n_nationkey")
    out = {
        "s": M.sin(x), "c": M.cos(x), "t": M.tan(x), "ct": M.cot(x + 0.5), "as_": M.asin(y), "ac": M.acos(y), "at": M.atan(x), "at2": M.atan2(y, x + 1), "sh": M.sinh(x), "ch": M.cosh(x), "th": M.tanh(x),
        "ash": M.asinh(x), "ach": M.acosh(x + 1), "ath": M.atanh(y / 2), "dg": M.degrees(x), "rd": M.radians(x), "sd": M.sind(k * 10), "cd": M.cosd(k * 10), "p": M.pi(),
    }
    return n.select("n_nationkey", *(F.round(v, 9).alias(c) for c, v in out.items()))


@query("""
    SELECT * FROM (VALUES (0, 0, 2, '8.41', 2, 1, 2, 8.0::DOUBLE, 2.0::DOUBLE, 3, 0, 11, 2, -3))
    t(nulls, ok, digits, trimmed, few, b1, b2, even, even2, bucket, below, above, of_array, divided)""")
def numeric_details(spark, d):
    row = spark.sql("SELECT CAST(8.4100 AS DECIMAL(10,4)) AS x, CAST(8.41 AS DECIMAL(10,2)) AS y")
    return row.select(
        M.num_nulls(F.col("x"), F.lit(1)).alias("nulls"), (M.num_nonnulls(F.col("x"), F.lit(None)) - 1).alias("ok"), M.scale("y").alias("digits"), M.trim_scale("x").alias("trimmed"), M.min_scale("x").alias("few"),
        M.to_int_from_numeric(F.lit(0.5).cast("decimal(2,1)")).cast("int").alias("b1"), M.to_int_from_double(F.lit(2.5)).cast("int").alias("b2"), M.round_double(F.lit(8.5)).alias("even"), M.round_double(F.lit(1.5)).alias("even2"),
        M.width_bucket(F.lit(5.35), 0.024, 10.06, 5).alias("bucket"), M.width_bucket(F.lit(-1.0), 0.0, 10.0, 10).alias("below"), M.width_bucket(F.lit(11.0), 0.0, 10.0, 10).alias("above"),
        M.width_bucket_of(F.lit(15), F.array(F.lit(1), F.lit(10), F.lit(20))).alias("of_array"), M.div(F.lit(-7).cast("decimal(5,0)"), F.lit(2).cast("decimal(5,0)")).cast("int").alias("divided"),
    )


@query("""
    SELECT o_orderkey, extract('year' FROM o_orderdate) AS y, extract('quarter' FROM o_orderdate) AS q, extract('dow' FROM o_orderdate) AS dow, extract('isodow' FROM o_orderdate) AS isodow,
           extract('doy' FROM o_orderdate) AS doy, extract('week' FROM o_orderdate) AS w, extract('decade' FROM o_orderdate) AS de, extract('century' FROM o_orderdate) AS ce, epoch(o_orderdate)::BIGINT AS ep,
           date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS wk, time_bucket(INTERVAL 15 DAY, o_orderdate, TIMESTAMP '2001-01-01') AS bin,
           o_orderdate + INTERVAL 1 MONTH AS next_month, o_orderdate - INTERVAL 10 DAY AS before, strftime(o_orderdate, '%Y/%m/%d') AS text, make_date(y::INT, 2, 3) AS made
    FROM (SELECT *, extract('year' FROM o_orderdate) AS y FROM orders)""")
def date_functions(spark, d):
    t = F.col("o_orderdate")
    return load(spark, d, "orders").select(
        "o_orderkey", *(D.extract(f, t).cast("long").alias(a) for f, a in (("year", "y"), ("quarter", "q"), ("dow", "dow"), ("isodow", "isodow"), ("doy", "doy"), ("week", "w"), ("decade", "de"), ("century", "ce"), ("epoch", "ep"))),
        D.date_trunc("month", t).alias("m"), D.date_trunc("week", t).alias("wk"), D.date_bin("15 days", t).alias("bin"), D.plus(t, D.interval("1 month")).alias("next_month"),
        D.minus(t, D.interval("10 days")).alias("before"), D.to_char(t, "YYYY/MM/DD").alias("text"), D.make_date(F.year(t), 2, 3).alias("made"),
    )


@query("""
    SELECT * FROM (VALUES (43, 9, 27, true, false, 'JUNE      7th 2023', ' 1,234.50', '-.5', DATE '2000-12-05', 2.5::DOUBLE, TIMESTAMP '2013-07-01 12:00:00', 17))
    t(age_years, age_months, age_days, over1, over2, spelled, number, small, parsed, seconds, made, hours)""")
def date_details(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    age = D.age(t("2001-04-10"), t("1957-06-13"))
    day = lambda x: F.lit(x).cast("date")
    return spark.range(1).select(
        D.extract_interval("year", age).alias("age_years"), D.extract_interval("month", age).alias("age_months"), D.extract_interval("day", age).alias("age_days"),
        D.overlaps(day("2001-02-16"), day("2001-12-21"), day("2001-10-30"), day("2002-10-30")).alias("over1"), D.overlaps(day("2001-10-29"), day("2001-10-30"), day("2001-10-30"), day("2001-10-31")).alias("over2"),
        D.to_char(t("2023-06-07"), 'MONTH FMDD"th" YYYY').alias("spelled"), D.to_char_number(F.lit(1234.5), "9,999.99").alias("number"), D.to_char_number(F.lit(-0.5), "FM9.9").alias("small"),
        D.to_date(F.lit("05 Dec 2000"), "DD Mon YYYY").alias("parsed"), D.date_part("second", t("2001-02-16 20:38:02.5")).alias("seconds"), D.make_timestamp(2013, 7, 1, 12, 0, 0.0).alias("made"),
        D.extract_interval("hour", D.interval("2 days 17:30:00")).cast("int").alias("hours"),
    )


@query("""
    SELECT p_partkey, array_to_string(list_append(w, 'x'), ',') AS appended, array_to_string(list_prepend('y', w), ',') AS prepended, len(w) AS n, list_position(w, w[2]) AS at,
           array_to_string(list_filter(w, lambda x: x <> w[1]), ',') AS removed, array_to_string(list_reverse(w), ',') AS reversed, array_to_string(list_sort(w), ',') AS sorted,
           list_contains(w, w[1]) AS has, '[1:' || len(w) || ']' AS dims, w[2] AS second, array_to_string(w[1:2], ',') AS slice, array_to_string(w[1:len(w) - 1], ',') AS shorter
    FROM (SELECT p_partkey, string_split(p_type, ' ') AS w FROM part)""")
def array_functions(spark, d):
    w = F.col("w")
    part = load(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("w"))
    text = lambda a: A.array_to_string(a, ",")
    return part.select(
        "p_partkey", text(A.array_append(w, "x")).alias("appended"), text(A.array_prepend("y", w)).alias("prepended"), A.array_length(w).alias("n"), A.array_position(w, A.subscript(w, 2)).alias("at"),
        text(A.array_remove(w, A.subscript(w, 1))).alias("removed"), text(A.array_reverse(w)).alias("reversed"), text(A.array_sort(w)).alias("sorted"), A.arraycontains(w, F.array(A.subscript(w, 1))).alias("has"),
        A.array_dims(w).alias("dims"), A.subscript(w, 2).alias("second"), text(A.slice_of(w, 1, 2)).alias("slice"), text(A.trim_array(w, 1)).alias("shorter"),
    )


@query("""
    SELECT * FROM (VALUES (NULL::INT, 0, 4, '2,4', '1,9,NULL,9', '7,7,7', true, false, true, '1,2,3,4', NULL::INT, 2))
    t(empty_length, empty_size, nested, places, replaced, filled, inside, outside, shared, joined, beyond, lower)""")
def array_details(spark, d):
    lit = lambda *x: F.array(*map(F.lit, x))
    empty = F.array().cast("array<int>")
    text = lambda a: A.array_to_string(a, ",", "NULL")
    nested = F.array(lit(1, 2), lit(3, 4))
    return spark.range(1).select(
        A.array_length(empty).alias("empty_length"), A.cardinality(empty).alias("empty_size"), A.cardinality(nested, 2).alias("nested"), text(A.array_positions(lit(1, 2, 3, 2), 2)).alias("places"),
        text(A.array_replace(lit(1, 2, None, 2), 2, 9)).alias("replaced"), text(A.array_fill(7, 3)).alias("filled"), A.arraycontained(lit(1, 2), lit(1, 2, 3)).alias("inside"), A.arraycontains(lit(1, None), lit(None).cast("array<int>")).alias("outside"),
        A.arrayoverlap(lit(1, 2), lit(2, 3)).alias("shared"), text(A.array_cat(lit(1, 2), lit(3, 4))).alias("joined"), A.subscript(lit(1, 2), 5).alias("beyond"), (A.array_lower(lit(5, 6)) + 1).alias("lower"),
    )


@query("""
    SELECT event_id, json_extract_string(props, k) AS value, json_type(props) = 'OBJECT' AS is_object, len(json_keys(props)) AS n_keys, json_exists(props, k) AS has_first
    FROM (SELECT event_id, props, json_keys(props)[1] AS k FROM events)""")
def json_access(spark, d):
    e = load(spark, d, "events").select("event_id", "props")
    first = F.get(J.object_keys("props"), F.lit(0))
    pairs = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.try_element_at(pairs, first).alias("value"), (J.typeof("props") == "object").alias("is_object"), F.size(J.object_keys("props")).alias("n_keys"), F.map_contains_key(pairs, first).alias("has_first"))


@query("""
    SELECT * FROM (VALUES ('{"a": 1, "b": [1, 2, {"c": null}]}', '"x"', 'x', '2', true, false, true, '{"a": 1, "z": 2}', '{"b": 2}', '[1, 3]', '{"a": {"b": 5}}', '{"a": [0, 9, 1]}', '{"a": 1}', '[3, 4]', true, true, 'array', '{"k" : 1, "m" : null}', '[1, "two", null]'))
    t(norm, field, field_text, path, contains, contains_not, has, merged, without, cut, changed, put, stripped, found, any_found, matched, kind, object, array_)""")
def json_functions(spark, d):
    j = lambda x: F.lit(x)
    doc = j('{"b":[1,2,{"c":null}],"a":1}')
    return spark.range(1).select(
        J.jsonb(doc).alias("norm"), J.object_field(j('{"k":"x"}'), "k").alias("field"), J.object_field_text(j('{"k":"x"}'), "k").alias("field_text"), J.extract_path(doc, "b", 1).alias("path"),
        J.contains(doc, j('{"b":[2]}')).alias("contains"), J.contains(doc, j('{"a":2}')).alias("contains_not"), J.exists(doc, "a").alias("has"), J.concat(j('{"a":1}'), j('{"z":2}')).alias("merged"),
        J.delete(j('{"a":1,"b":2}'), "a").alias("without"), J.delete(j("[1,2,3]"), 1).alias("cut"), J.set(j('{"a":{"b":1}}'), ["a", "b"], j("5")).alias("changed"), J.insert(j('{"a":[0,1]}'), ["a", 1], j("9")).alias("put"),
        J.strip_nulls(j('{"a":1,"b":null}')).alias("stripped"), J.path_query_array(j('{"x":[1,3,4]}'), "$.x[*] ? (@ > 2)").alias("found"), J.path_exists(doc, "$.b[*].c").alias("any_found"),
        J.path_match(doc, "$.a == 1").alias("matched"), J.typeof(J.extract_path(doc, "b")).alias("kind"), J.build_object("k", 1, "m", F.lit(None)).alias("object"), J.build_array(1, "two", F.lit(None)).alias("array_"),
    )


@query("""
    SELECT * FROM (VALUES ('a,b', '1,NULL', true, true, false, '1', '{"a": "1", "b": null}', '{"a": 1, "b": null}', 'a,1,b,NULL', '2', true, 1))
    t(keys, vals, has, has_null, set_, val, json, loose, flat, overwritten, contains, left_))""".replace("left_))", "left_)"))
def map_functions(spark, d):
    h = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    new = F.create_map(F.lit("a"), F.lit("2"))
    text = lambda a: A.array_to_string(a, ",", "NULL")
    return spark.range(1).select(h.alias("h"), new.alias("new")).select(
        text(H.akeys("h")).alias("keys"), text(H.avals("h")).alias("vals"), H.exist("h", "a").alias("has"), H.exist("h", "b").alias("has_null"), H.defined("h", "b").alias("set_"), H.fetchval("h", "a").alias("val"),
        H.hstore_to_json("h").alias("json"), H.hstore_to_json_loose("h").alias("loose"), text(H.hstore_to_array("h")).alias("flat"), H.fetchval(H.hs_concat("h", F.col("new")), "a").alias("overwritten"),
        H.hs_contains("h", F.create_map(F.lit("a"), F.lit("1"))).alias("contains"), F.size(H.delete("h", "a")).alias("left_"),
    )


@query("""
    SELECT * FROM (VALUES (32.0::DOUBLE, 27.0::DOUBLE, 9.0::DOUBLE, '5.0,7.0,9.0', '-3.0,-3.0,-3.0', '4.0,10.0,18.0', '1.0,2.0,3.0,4.0,5.0,6.0', '2.0,3.0', '101', 2.0::DOUBLE, 0.5::DOUBLE, 3))
    t(dot, squared, l1, added, less, times, joined, part_, bits, hamming, jaccard, dims)""")
def vector_functions(spark, d):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (4.0, 5.0, 6.0)))
    text = lambda x: A.array_to_string(x, ",")
    return spark.range(1).select(
        V.inner_product(a, b).alias("dot"), V.l2_squared_distance(a, b).alias("squared"), V.l1_distance(a, b).alias("l1"), text(V.vector_add(a, b)).alias("added"), text(V.vector_sub(a, b)).alias("less"), text(V.vector_mul(a, b)).alias("times"),
        text(V.vector_concat(a, b)).alias("joined"), text(V.subvector(a, 2, 2)).alias("part_"), V.binary_quantize(F.array(*map(F.lit, (1.0, -1.0, 2.0)))).alias("bits"), V.hamming_distance("1010", "1100").alias("hamming"),
        V.jaccard_distance("1100", "1000").alias("jaccard"), V.vector_dims(a).alias("dims"),
    )


@query("""
    SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS lexemes, contains(' ' || p_name || ' ', ' ' || string_split(p_name, ' ')[1] || ' ') AS matched
    FROM part""")
def text_search(spark, d):
    part = load(spark, d, "part").select("p_partkey", TS.to_tsvector("p_name").alias("v"), F.split("p_name", " ")[0].alias("word"))
    return part.select("p_partkey", F.array_join(TS.tsvector_to_array(F.col("v")), " ").alias("lexemes"), TS.ts_match_vq(F.col("v"), F.col("word")).alias("matched"))


@query("""
    SELECT * FROM (VALUES ('''cat'':2,5 ''fat'':1 ''rat'':4 ''the'':3', '''cat'' & ''fat''', '''cat'' <-> ''fat''', true, false, 'the <b>cat</b> sat', '''cat'' ''fat''', '''fat'':1', 3, 0.1::FLOAT))
    t(vector, query, phrase, yes, no, headline, stripped, deleted, nodes, rank)""")
def text_search_details(spark, d):
    v, q = F.lit("'cat':2 'fat':1"), F.lit("cat & fat")
    return spark.range(1).select(
        TS.to_tsvector(F.lit("Fat cat the rat cat")).alias("vector"), TS.to_tsquery(q).alias("query"), TS.phraseto_tsquery(F.lit("cat fat")).alias("phrase"), TS.ts_match_vq(v, q).alias("yes"), TS.ts_match_vq(v, F.lit("dog")).alias("no"),
        TS.ts_headline(F.lit("the cat sat"), F.lit("cat")).alias("headline"), TS.strip(v).alias("stripped"), TS.ts_delete(v, "cat").alias("deleted"), TS.numnode(q).alias("nodes"), TS.ts_rank(v, q).alias("rank"),
    )


@query("""
    SELECT n_nationkey, md5(n_name) AS m, sha1(n_name) AS s1, sha256(n_name) AS s256
    FROM nation""")
def digests(spark, d):
    hex_ = lambda kind: F.lower(F.hex(X.digest("n_name", kind)))
    return load(spark, d, "nation").select("n_nationkey", hex_("md5").alias("m"), hex_("sha1").alias("s1"), hex_("sha256").alias("s256"))


@query("""
    SELECT * FROM (VALUES ('de7c9b85b8b78aa6bc8a7a36f70a90701c9db4d9', 2591144780, 3421780262, true, 'plain text', '9073926b-929f-31c2-abc9-fad77ae3e8eb', 'cfbff0d1-9375-5685-968c-48ce8b15ae17', 7, 4, '<a x="1">b&lt;c</a>', '<!--hi-->', true, false, '1000', 2, '10.0.0.1', 24))
    t(mac, castagnoli, crc, same, plain, v3, v5, version, four, element, comment, formed, unformed, anded, ones, host, bits)""")
def identifiers_and_codes(spark, d):
    key = b"0123456789abcdef"
    u7 = F.lit("017f22e2-79b0-7cc3-98c4-dc0c0c07398f")
    return spark.range(1).select(
        F.lower(F.hex(X.hmac(F.lit("The quick brown fox jumps over the lazy dog"), "key", "sha1"))).alias("mac"), X.crc32c(F.lit("hello")).alias("castagnoli"), X.crc32(F.lit("123456789")).alias("crc"),
        (X.decrypt(X.encrypt(F.lit("plain text"), key), key).cast("string") == "plain text").alias("same"), X.decrypt_iv(X.encrypt_iv(F.lit("plain text"), key, key), key, key).cast("string").alias("plain"),
        X.uuid_generate_v3(X.NAMESPACES["dns"], F.lit("example.com")).alias("v3"), X.uuid_generate_v5(X.NAMESPACES["dns"], F.lit("example.com")).alias("v5"), X.uuid_extract_version(u7).alias("version"), X.uuid_extract_version(X.gen_random_uuid()).alias("four"),
        X.xmlelement("a", {"x": F.lit(1)}, "b<c").alias("element"), X.xmlcomment("hi").alias("comment"), X.xml_is_well_formed(F.lit("<a><b/></a>")).alias("formed"), X.xml_is_well_formed(F.lit("<a>")).alias("unformed"),
        X.bit_and("1010", "1100").alias("anded"), X.bit_count("1010").cast("int").alias("ones"), X.host(F.lit("10.0.0.1/24")).alias("host"), X.masklen(F.lit("10.0.0.1/24")).alias("bits"),
    )


@query("SELECT * FROM (VALUES ('integer', 'text', 'bigint[]', 'numeric', 'record', true, false)) t(i, s, a, n, r, good, bad)")
def type_functions(spark, d):
    t = X.pg_typeof
    return spark.range(1).select(
        t(F.lit(1)).alias("i"), t(F.lit("a")).alias("s"), t(F.array(F.col("id"))).alias("a"), t(F.lit(1).cast("decimal(5,1)")).alias("n"), t(F.struct("id")).alias("r"), X.pg_input_is_valid(F.lit("12"), "int").alias("good"), X.pg_input_is_valid(F.lit("x"), "int").alias("bad")
    )


@query("SELECT c_custkey, array_to_string(list_sort(array_agg(DISTINCT o_orderstatus)), '') AS statuses FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def string_agg_distinct(spark, d):
    o = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(R.string_agg("o_orderstatus", "", distinct=True).alias("statuses"))
    return load(spark, d, "customer").select("c_custkey").join(o, "c_custkey")
