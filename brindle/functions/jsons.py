"""JSON as text: json keeps what was written, jsonb is a normal form with unique, ordered keys.

Reading goes through the engine's variant type; changes, containment and paths that it lacks run in Arrow batches.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.base import col, val
from brindle.functions.jsonpath import evaluate, parse_path
from brindle.functions.textsearch import STOP_WORDS


def loads(text: str) -> Any:
    return json.loads(text, parse_float=Decimal, parse_int=Decimal)


def dumps(x: Any) -> str:
    """Normal form: keys by length in bytes, then by bytes; blanks behind colons and commas."""
    if isinstance(x, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {dumps(v)}" for k, v in sorted(x.items(), key=lambda p: (len(p[0].encode()), p[0].encode()))) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(dumps, x)) + "]"
    if isinstance(x, Decimal):
        return f"{x:f}"
    return json.dumps(x, ensure_ascii=False)


def _text(x: Any) -> str | None:
    return None if x is None else x if isinstance(x, str) else dumps(x)


def _udf(kind, f):
    """A strict function of one JSON text and fixed further arguments, over Arrow batches."""

    def call(j, *more):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else f(loads(t), *more))

        return F.pandas_udf(run, kind)(col(j))

    return call


def _udf2(kind, f):
    """The same with two JSON columns."""

    def call(a, b, *more):
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if t is None or u is None else f(loads(t), loads(u), *more) for t, u in zip(x, y, strict=True)], dtype=object)

        return F.pandas_udf(run, kind)(col(a), val(b))

    return call


jsonb = _udf(T.StringType(), dumps)


def _variant(j) -> Column:
    return F.try_parse_json(col(j))


def _step(key: str | int) -> str:
    return f"[{key}]" if isinstance(key, int) else "['" + key.replace("'", "\\'") + "']"


def _path(keys) -> str:
    return "$" + "".join(_step(int(k) if isinstance(k, str) and k.isdigit() else k) for k in keys)


def _at(x: Any, keys: list) -> Any:
    """What lies at a path; raises KeyError if nothing does.  Negative places count from the end."""
    for k in keys:
        if isinstance(x, list):
            i = int(k)
            if not -len(x) <= i < len(x):
                raise KeyError(k)
            x = x[i]
        elif isinstance(x, dict):
            x = x[str(k)]
        else:
            raise KeyError(k)
    return x


def _get(x: Any, keys: list, text: bool) -> str | None:
    try:
        found = _at(x, keys)
    except (KeyError, ValueError):
        return None
    return _text(found) if text else dumps(found)


def object_field(j, key: str) -> Column:
    """j -> key, as JSON."""
    return F.to_json(F.try_variant_get(_variant(j), f"$['{key}']" if "'" not in key else f'$["{key}"]', "variant"))


def object_field_text(j, key: str) -> Column:
    """j ->> key, as text."""
    return F.try_variant_get(_variant(j), f"$['{key}']" if "'" not in key else f'$["{key}"]', "string")


def array_element(j, i: int) -> Column:
    return F.to_json(F.try_variant_get(_variant(j), f"$[{i}]", "variant")) if i >= 0 else extract_path(j, i)


def array_element_text(j, i: int) -> Column:
    return F.try_variant_get(_variant(j), f"$[{i}]", "string") if i >= 0 else extract_path_text(j, i)


def extract_path(j, *keys) -> Column:
    """j #> keys; a key that is a number is a place in an array or a name in an object."""
    return _udf(T.StringType(), lambda x: _get(x, list(keys), False))(j)


def extract_path_text(j, *keys) -> Column:
    """j #>> keys."""
    return _udf(T.StringType(), lambda x: _get(x, list(keys), True))(j)


def array_length(j) -> Column:
    return F.json_array_length(col(j))


def object_keys(j) -> Column:
    return F.json_object_keys(col(j))


def typeof(j) -> Column:
    kind = F.schema_of_variant(_variant(j))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.isin("VOID", "NULL"), "null").when(kind.isNotNull(), "number")
    )


def exists(j, key: str) -> Column:
    """j ? key: a key of an object, or a text in an array."""
    return _udf(T.BooleanType(), lambda x: key in x if isinstance(x, (dict, list)) else x == key)(j)


def exists_any(j, keys: list[str]) -> Column:
    return _udf(T.BooleanType(), lambda x: any(k in x for k in keys) if isinstance(x, (dict, list)) else x in keys)(j)


def exists_all(j, keys: list[str]) -> Column:
    return _udf(T.BooleanType(), lambda x: all(k in x for k in keys) if isinstance(x, (dict, list)) else keys == [x])(j)


def _contains(a: Any, b: Any, top: bool = True) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v, False) for k, v in b.items())
    if isinstance(a, list):
        if isinstance(b, list):
            return all(any(_contains(x, y, False) for x in a) for y in b)
        return top and not isinstance(b, dict) and any(_same(x, b) for x in a)
    return _same(a, b)


def _same(a: Any, b: Any) -> bool:
    return type(a) is type(b) and a == b


contains = _udf2(T.BooleanType(), _contains)


def contained(a, b) -> Column:
    return contains(val(b), col(a))


def _concat(a: Any, b: Any) -> str:
    if isinstance(a, dict) and isinstance(b, dict):
        return dumps(a | b)
    return dumps((a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b]))


concat = _udf2(T.StringType(), _concat)


def _delete(x: Any, what) -> str:
    if isinstance(x, dict):
        names = [what] if isinstance(what, str) else what
        return dumps({k: v for k, v in x.items() if k not in names})
    if isinstance(what, int):
        at = what + len(x) if what < 0 else what
        return dumps([v for i, v in enumerate(x) if i != at])
    names = [what] if isinstance(what, str) else what
    return dumps([v for v in x if not (isinstance(v, str) and v in names)])


def delete(j, what: str | int | list[str]) -> Column:
    """j - what: a key, a place, or keys."""
    return _udf(T.StringType(), _delete)(j, what)


def _delete_path(x: Any, path: list) -> str:
    try:
        parent = _at(x, path[:-1]) if path else None
        if isinstance(parent, dict):
            parent.pop(str(path[-1]), None)
        elif isinstance(parent, list) and -len(parent) <= int(path[-1]) < len(parent):
            del parent[int(path[-1])]
    except (KeyError, ValueError):
        pass
    return dumps(x)


def delete_path(j, path: list) -> Column:
    return _udf(T.StringType(), _delete_path)(j, path)


def _set(x: Any, new: Any, path: list, create: bool, insert: bool, after: bool) -> str:
    if not path:
        return dumps(x)
    try:
        parent = _at(x, path[:-1])
    except (KeyError, ValueError):
        return dumps(x)
    if isinstance(parent, dict):
        k = str(path[-1])
        if insert and k in parent:
            raise ValueError("cannot replace existing key")
        if create or insert or k in parent:
            parent[k] = new
    elif isinstance(parent, list):
        i = int(path[-1])
        at = i + len(parent) if i < 0 else i
        if insert:
            parent.insert(min(max(at + after, 0), len(parent)), new)
        elif 0 <= at < len(parent):
            parent[at] = new
        elif create:
            parent.insert(0 if i < 0 else len(parent), new)
    return dumps(x)


def set(j, path: list, new, create: bool = True) -> Column:
    """jsonb_set: replaces what lies at a path or, if told, adds it."""
    return _udf2(T.StringType(), lambda x, y: _set(x, y, path, create, False, False))(j, new)


def insert(j, path: list, new, after: bool = False) -> Column:
    return _udf2(T.StringType(), lambda x, y: _set(x, y, path, True, True, after))(j, new)


def set_lax(j, path: list, new, create: bool = True, null: str = "use_json_null") -> Column:
    """Like set, with a choice for a null value: use_json_null, delete_key, return_target or raise_exception."""
    other = {"use_json_null": lambda: set(j, path, F.lit("null"), create), "delete_key": lambda: delete_path(j, path), "return_target": lambda: jsonb(j), "raise_exception": lambda: F.raise_error(F.lit("JSON value must not be null"))}[null]()
    return F.when(val(new).isNull(), other).otherwise(set(j, path, new, create))


def _strip(x: Any, arrays: bool) -> Any:
    if isinstance(x, dict):
        return {k: _strip(v, arrays) for k, v in x.items() if v is not None}
    if isinstance(x, list):
        return [_strip(v, arrays) for v in x if not (arrays and v is None)]
    return x


def strip_nulls(j, arrays: bool = False) -> Column:
    return _udf(T.StringType(), lambda x: dumps(_strip(x, arrays)))(j)


def _pretty(x: Any, depth: int = 0) -> str:
    pad, end = "    " * (depth + 1), "    " * depth
    if isinstance(x, dict) and x:
        pairs = sorted(x.items(), key=lambda p: (len(p[0].encode()), p[0].encode()))
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {_pretty(v, depth + 1)}" for k, v in pairs) + f"\n{end}}}"
    if isinstance(x, list) and x:
        return "[\n" + ",\n".join(pad + _pretty(v, depth + 1) for v in x) + f"\n{end}]"
    return dumps(x)


pretty = _udf(T.StringType(), _pretty)


def to_json(x) -> Column:
    """Any value as JSON; fields that are null stay."""
    made = F.to_json(F.struct(val(x).alias("a")), {"ignoreNullFields": "false"})
    return F.regexp_extract(made, r"(?s)^\{\"a\":(.*)\}$", 1)


to_jsonb = json_scalar = to_json


def row_to_json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def build_array(*args) -> Column:
    return F.concat(F.lit("["), F.concat_ws(", ", *(_value(a) for a in args)), F.lit("]"))


def _value(x) -> Column:
    return F.coalesce(to_json(x), F.lit("null"))


def build_object(*args) -> Column:
    """Of keys and values in turn, in that order, with blanks around colons."""
    pairs = [F.concat(to_json(val(k).cast("string")), F.lit(" : "), _value(v)) for k, v in zip(args[::2], args[1::2], strict=True)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def json_object(keys, values=None) -> Column:
    keys = col(keys)
    if values is None:
        at = F.sequence(F.lit(0), F.size(keys) - 1, F.lit(2))
        pairs = F.transform(at, lambda i: F.struct(F.get(keys, i).alias("k"), F.get(keys, i + 1).alias("v")))
    else:
        pairs = F.arrays_zip(keys.alias("k"), col(values).alias("v"))
    one = F.transform(pairs, lambda p: F.concat(_quoted(p["k"]), F.lit(" : "), F.coalesce(_quoted(p["v"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))


def _quoted(x: Column) -> Column:
    return F.when(x.isNotNull(), F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1))


def populate_record(j, schema: str) -> Column:
    return F.from_json(col(j), schema)


def is_json(x, kind: str = "value") -> Column:
    """IS JSON [value, scalar, array, object]."""
    parsed = typeof(x)
    ok = {"value": parsed.isNotNull(), "scalar": parsed.isin("string", "number", "boolean", "null"), "array": parsed == "array", "object": parsed == "object"}[kind]
    return F.when(col(x).isNotNull(), F.coalesce(ok, F.lit(False)))


# Paths


def path_query_array(j, path: str) -> Column:
    tree = parse_path(path)
    return _udf(T.StringType(), lambda x: dumps(evaluate(tree, x)))(j)


def path_query(j, path: str) -> Column:
    """What the path finds, as an array of JSON texts to be exploded."""
    tree = parse_path(path)
    return _udf(T.ArrayType(T.StringType()), lambda x: [dumps(v) for v in evaluate(tree, x)])(j)


def path_query_first(j, path: str) -> Column:
    return F.get(path_query(j, path), F.lit(0))


def path_exists(j, path: str) -> Column:
    """The operator @?."""
    tree = parse_path(path)
    return _udf(T.BooleanType(), lambda x: bool(evaluate(tree, x)))(j)


def path_match(j, path: str) -> Column:
    """The operator @@: the path is a predicate."""
    tree = parse_path(path)

    def one(x):
        found = evaluate(tree, x)
        return found[0] if found and isinstance(found[0], bool) else None

    return _udf(T.BooleanType(), one)(j)


json_exists, json_query = path_exists, path_query_first


def json_value(j, path: str) -> Column:
    tree = parse_path(path)

    def one(x):
        found = evaluate(tree, x)
        return _text(found[0]) if found and not isinstance(found[0], (dict, list)) else None

    return _udf(T.StringType(), one)(j)


# Arrays to be exploded by the set-returning functions


def elements(j) -> Column:
    return _udf(T.ArrayType(T.StringType()), lambda x: [dumps(v) for v in x])(j)


def elements_text(j) -> Column:
    return _udf(T.ArrayType(T.StringType()), lambda x: [_text(v) for v in x])(j)


_PAIRS = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


def _pairs(j, text: bool) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"key": k, "value": _text(v) if text else dumps(v)} for k, v in loads(t).items()])

    return F.pandas_udf(run, _PAIRS)(col(j))


def each(j) -> Column:
    return _pairs(j, False)


def each_text(j) -> Column:
    return _pairs(j, True)


def _words(x: Any, kinds: tuple[str, ...]) -> list[str]:
    wants = lambda k: "all" in kinds or k in kinds

    def visit(y):
        if isinstance(y, dict):
            for k, v in y.items():
                if wants("key"):
                    yield k
                yield from visit(v)
        elif isinstance(y, list):
            for v in y:
                yield from visit(v)
        elif isinstance(y, bool):
            if wants("boolean"):
                yield "true" if y else "false"
        elif isinstance(y, Decimal):
            if wants("numeric"):
                yield f"{y:f}"
        elif isinstance(y, str) and wants("string"):
            yield y

    return [w for t in visit(x) for w in re.findall("[a-z0-9_]+", t.lower())]


def words(j, kinds: tuple[str, ...] = ("all",)) -> Column:
    """Words of a document's keys and values in order."""
    return _udf(T.ArrayType(T.StringType()), lambda x: _words(x, kinds))(j)


def to_tsvector(j, kinds: tuple[str, ...] = ("all",), config: str = "english") -> Column:
    """A text search vector of a document's keys and values."""
    stop = STOP_WORDS if config.lower() == "english" else []

    def vector(x: Any) -> str:
        places: dict[str, list[str]] = {}
        for i, w in enumerate(_words(x, kinds), 1):
            places.setdefault(w, []).append(str(i))
        return " ".join(f"'{w}':{','.join(p)}" for w, p in sorted(places.items()) if w not in stop)

    return _udf(T.StringType(), vector)(j)


remove_path = delete_path


def serialize(j) -> Column:
    """JSON as its text."""
    return col(j).cast("string")
