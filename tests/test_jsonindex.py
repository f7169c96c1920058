"""Token indexes against brute force: several keys, nested values, arrays, scalars, nulls and repeated ids."""

import json

import pytest

from brindle.functions import jsons
from brindle.operators import jsonindex

DOCS = ['{"a":1}', '{"b":1}', '{"b":2,"a":1}', '{"a":1.0,"c":{"d":[1,{"e":"x"}]}}', '{"a":"1"}', '{"c":{"d":[{"e":"y"},2]}}', "[1,\"a\",[2]]", '["b"]', '"a"', "1", "-0.0", "null", "true", "{}", "[]", '{"a":{}}', '{"a":null}', '{"c":{"e":"x"}}', None]
ROWS = [(i, d) for i, d in enumerate(DOCS)] + [(None, '{"a":1}'), (1, '{"z":1}'), (2, '{"q":5}')]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, doc string")


def got(df):
    return sorted(map(str, df.collect()))


def want(spark, test):
    return got(spark.createDataFrame([r for r in ROWS if r[1] is not None and test(jsons.loads(r[1]))], "id int, doc string"))


def test_containment(spark, docs):
    index = jsonindex.token_index(docs, "id", "doc")
    for part in ['{"a":1}', '{"b":1}', '{"a":1,"b":2}', '{"c":{"d":[{"e":"x"}]}}', '{"c":{"d":[2]}}', "[1]", "[[2]]", '"a"', "0", "{}", "[]", '{"a":{}}', '{"a":null}', '{"no":1}']:
        b = jsons.loads(part)
        assert got(jsonindex.containing(docs, index, "id", "doc", part)) == want(spark, lambda a, b=b: jsons._contains(a, b)), part


def test_existence(spark, docs):
    index = jsonindex.token_index(docs, "id", "doc")
    has = lambda a, k: k in a if isinstance(a, (dict, list)) else a == k
    for keys in (["a"], ["a", "b"], ["c", "a"], [], ["no"]):
        assert got(jsonindex.having_all(docs, index, "id", "doc", keys)) == want(spark, lambda a, ks=keys: isinstance(a, (dict, list)) and all(has(a, k) for k in ks) or ks == [a]), keys
        assert got(jsonindex.having_any(docs, index, "id", "doc", keys)) == want(spark, lambda a, ks=keys: any(has(a, k) for k in ks)), keys


def test_tokens_of_the_whole_document(spark, docs):
    found = {tuple(json.loads(r.token)) for r in jsonindex.token_index(docs, "id", "doc").filter("id = 5").collect()}
    assert found == {("top", "c"), ("key", "c"), ("key", "c", "d"), ("key", "c", "d", "e"), ("value", "c", "d", "e", "str", "y"), ("value", "c", "d", "number", "2")}
