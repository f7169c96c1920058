"""hstore functions over maps of text to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.base import col, val

NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def hstore(keys, values=None):
    """Of a key and a value, two arrays, or one array of both in turn; the first of repeated keys stays."""
    if values is None:
        a = col(keys)
        at = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(2))).otherwise(F.array().cast("array<int>"))
        entries = F.transform(at, lambda i: F.struct(F.get(a, i - 1).alias("key"), F.get(a, i).alias("value")))
        return _from_entries(entries)
    return _from_entries(F.arrays_zip(col(keys).alias("key"), col(values).alias("value")))


def _from_entries(entries: Column) -> Column:
    keys = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.map_from_entries(first)


def tconvert(key, value):
    return F.create_map(val(key), val(value))


def akeys(h):
    return F.map_keys(col(h))


def avals(h):
    return F.map_values(col(h))


def exist(h, key):
    return F.map_contains_key(col(h), val(key))


isexists = exist


def defined(h, key):
    return F.try_element_at(col(h), val(key)).isNotNull()


isdefined = defined


def exists_all(h, keys):
    return F.size(F.array_except(val(keys), F.map_keys(col(h)))) == 0


def exists_any(h, keys):
    return F.arrays_overlap(F.map_keys(col(h)), val(keys))


def fetchval(h, key):
    return F.try_element_at(col(h), val(key))


def delete(h, what):
    """Without a key, without keys, or without the pairs of another map."""
    h = col(h)
    if isinstance(what, str):
        return F.map_filter(h, lambda k, v: k != what)
    if isinstance(what, (list, tuple)):
        return F.map_filter(h, lambda k, v: ~k.isin(*what))
    return F.map_filter(h, lambda k, v: ~(F.map_contains_key(what, k) & F.try_element_at(what, k).eqNullSafe(v)))


def hs_concat(a, b):
    """Pairs of both; of shared keys those of b."""
    a, b = col(a), val(b)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def hs_contains(a, b):
    a = col(a)
    return F.forall(F.map_entries(val(b)), lambda e: F.map_contains_key(a, e["key"]) & F.try_element_at(a, e["key"]).eqNullSafe(e["value"]))


def hs_contained(a, b):
    return hs_contains(val(b), col(a))


def slice(h, keys):
    return F.map_filter(col(h), lambda k, v: F.array_contains(val(keys), k))


def slice_array(h, keys):
    return F.transform(val(keys), lambda k: F.try_element_at(col(h), k))


def _sorted(h) -> Column:
    """Entries as hstore keeps them: shorter keys first, then by text."""
    return F.array_sort(F.map_entries(col(h)), lambda a, b: F.when(F.octet_length(a["key"]) != F.octet_length(b["key"]), F.octet_length(a["key"]) - F.octet_length(b["key"])).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def hstore_to_array(h):
    return F.flatten(F.transform(_sorted(h), lambda e: F.array(e["key"], e["value"])))


def hstore_to_matrix(h):
    return F.transform(_sorted(h), lambda e: F.array(e["key"], e["value"]))


def _json_text(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)


def hstore_to_json(h):
    pairs = F.transform(_sorted(h), lambda e: F.concat(_json_text(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(_json_text(e["value"]))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def hstore_to_json_loose(h):
    """Numbers and booleans without quotes."""
    value = lambda v: F.when(v.isNull(), "null").when(v == "t", "true").when(v == "f", "false").when(v.rlike(NUMBER), v).otherwise(_json_text(v))
    pairs = F.transform(_sorted(h), lambda e: F.concat(_json_text(e["key"]), F.lit(": "), value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def equal(a, b):
    """Maps can't be compared; their sorted entries can."""
    return _sorted(a) == _sorted(b)


def group_key(h):
    return _sorted(h)


def populate_record(h, schema: str):
    return F.from_json(F.to_json(col(h)), schema)


def hstore_to_jsonb(h):
    from brindle.functions.jsons import jsonb

    return jsonb(hstore_to_json(h))


def hstore_to_jsonb_loose(h):
    from brindle.functions.jsons import jsonb

    return jsonb(hstore_to_json_loose(h))
