"""Functions that stand behind operators or settings, by the names SQL calls them: concatenations, comparisons of maps and
vectors, settings, identifiers' name spaces, set-returning functions as generators."""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import jsons, maps, strings
from brindle.functions.base import col, val

# Concatenation


def textcat(a, b) -> Column:
    return F.concat(val(a), val(b))


def anytextcat(a, b) -> Column:
    return F.concat(val(a).cast("string"), val(b))


def textanycat(a, b) -> Column:
    return F.concat(val(a), val(b).cast("string"))


def byteacat(a, b) -> Column:
    return F.concat(val(a).cast("binary"), val(b).cast("binary"))


#: Bit strings are texts of zeros and ones.
bitcat = textcat

# Comparison


def _ordered(h) -> Column:
    return F.array_sort(F.map_entries(col(h)))


def hstore_eq(a, b) -> Column:
    return maps.equal(a, b)


def hstore_ne(a, b) -> Column:
    return ~maps.equal(a, b)


def hstore_lt(a, b) -> Column:
    return _ordered(a) < _ordered(b)


def hstore_le(a, b) -> Column:
    return _ordered(a) <= _ordered(b)


def hstore_gt(a, b) -> Column:
    return _ordered(a) > _ordered(b)


def hstore_ge(a, b) -> Column:
    return _ordered(a) >= _ordered(b)


def vector_lt(a, b) -> Column:
    """By the first component that differs, then by length."""
    return col(a) < col(b)


def vector_le(a, b) -> Column:
    return col(a) <= col(b)


def vector_ge(a, b) -> Column:
    return col(a) >= col(b)


def vector_gt(a, b) -> Column:
    return col(a) > col(b)


# Settings of the session

_SETTING = "brindle.setting."


def set_config(name: str, value: str | None, is_local: bool = False) -> Column:
    """Set a setting when the query is made, and give its value.  There are no transactions, so a local one lasts too."""
    SparkSession.active().conf.set(_SETTING + name.lower(), value or "")
    return F.lit(value or "")


set_config_local = set_config


def current_setting(name: str, missing_ok: bool = False) -> Column:
    """A setting's value when the query is made; one that was never set is an error, or null."""
    conf = SparkSession.active().conf
    found = conf.get(_SETTING + name.lower(), None)
    if found is None and name.lower() == "timezone":
        found = conf.get("spark.sql.session.timeZone")
    if found is None and not missing_ok:
        raise ValueError(f'unrecognized configuration parameter "{name}"')
    return F.lit(found).cast("string")


# Identifiers: the name spaces of RFC 4122.  Fixed values.


def uuid_nil() -> Column:
    return F.lit("00000000-0000-0000-0000-000000000000")


def uuid_ns_dns() -> Column:
    return F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8")


def uuid_ns_url() -> Column:
    return F.lit("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def uuid_ns_oid() -> Column:
    return F.lit("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def uuid_ns_x500() -> Column:
    return F.lit("6ba7b814-9dad-11d1-80b4-00c04fd430c8")


# ASCII armor of RFC 4880


def _crc24(raw: bytes) -> int:
    crc = 0xB704CE
    for byte in raw:
        crc ^= byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


@F.pandas_udf(T.StringType())
def _armor(raw: pd.Series, headers: pd.Series) -> pd.Series:
    def one(x: bytes | None, head: str) -> str | None:
        if x is None:
            return None
        body = base64.b64encode(x).decode()
        lines = "".join(body[i : i + 76] + "\n" for i in range(0, len(body), 76))
        check = base64.b64encode(_crc24(x).to_bytes(3)).decode()
        return f"-----BEGIN PGP MESSAGE-----\n{head}\n{lines}={check}\n-----END PGP MESSAGE-----\n"

    return pd.Series([one(x, h) for x, h in zip(raw, headers, strict=True)])


def armor(x, headers: dict[str, str] | None = None) -> Column:
    return _armor(col(x).cast("binary"), F.lit("".join(f"{k}: {v}\n" for k, v in (headers or {}).items())))


@F.pandas_udf(T.BinaryType())
def _dearmor(text: pd.Series) -> pd.Series:
    def one(x: str | None) -> bytes | None:
        if x is None:
            return None
        m = re.search(r"-----BEGIN [^\n]*-----\r?\n(?:[^\n]+: [^\n]*\n)*\r?\n([A-Za-z0-9+/=\s]*?)\n=([A-Za-z0-9+/]{4})\s*\n-----END ", x)
        if not m:
            raise ValueError("Corrupt ascii-armor")
        try:
            raw = base64.b64decode(m[1])
        except binascii.Error as e:
            raise ValueError("Corrupt ascii-armor") from e
        if base64.b64decode(m[2]) != _crc24(raw).to_bytes(3):
            raise ValueError("Corrupt ascii-armor")
        return raw

    return text.map(one)


def dearmor(x) -> Column:
    return _dearmor(col(x))


def pgp_armor_headers(x) -> Column:
    """The header lines as a map."""
    head = F.regexp_extract(col(x), r"(?s)-----BEGIN [^\n]*-----\r?\n(.*?)\n\r?\n", 1)
    names, values = (F.regexp_extract_all(head, F.lit(r"(?m)^([^:\n]+): ([^\n\r]*)"), F.lit(i)) for i in (1, 2))
    return F.map_from_arrays(names, values)


# Text search


def querytree(query) -> Column:
    """The part of a query that an index can answer: T if that is nothing."""
    q = val(query)
    return F.when(F.trim(q) == "", F.lit("")).when(F.rlike(q, F.lit(r"^\s*!")), F.lit("T")).otherwise(q)


# Set-returning functions: generators, for a select list


def unnest(x) -> Column:
    return F.explode(col(x))


def generate_series(start, stop, step=1) -> Column:
    """A row for each number; none if the step leads away from the end."""
    a, b, s = val(start), val(stop), val(step)
    return F.explode(F.when(s == 0, F.raise_error(F.lit("step size cannot equal zero"))).when((b - a) * s >= 0, F.sequence(a, b, s)).otherwise(F.array().cast("array<int>")))


def generate_subscripts(x, dimension: int = 1) -> Column:
    n = F.size(col(x))
    return F.explode(F.when((n > 0) & F.lit(dimension == 1), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))


def json_array_elements(x) -> Column:
    return F.explode(jsons.elements(x))


def json_array_elements_text(x) -> Column:
    return F.explode(jsons.elements_text(x))


jsonb_array_elements, jsonb_array_elements_text = json_array_elements, json_array_elements_text


def regexp_split_to_table(s, pattern: str, flags: str = "") -> Column:
    return F.explode(strings.regexp_split_to_array(s, pattern, flags))


def string_to_table(s, separator, null_string=None) -> Column:
    return F.explode(strings.string_to_array(s, separator, null_string))


def each(h) -> Column:
    return F.explode(col(h))


def skeys(h) -> Column:
    return F.explode(F.map_keys(col(h)))


def svals(h) -> Column:
    return F.explode(F.map_values(col(h)))


# JSON


def to_json(x) -> Column:
    return jsons.to_json(x)


to_jsonb = to_json


def row_to_json(*columns) -> Column:
    return jsons.row_to_json(*columns)


# What a server would say of itself


def pg_is_in_recovery() -> Column:
    return F.lit(False)


def pg_table_size(rows: int = 0) -> Column:
    """Tables are folders of files that the engine doesn't own: none is counted."""
    return F.lit(rows).cast("long")


def unicode_version() -> Column:
    """The version by which this process classifies characters."""
    import unicodedata

    return F.lit(unicodedata.unidata_version)


def unicode_assigned(s) -> Column:
    r"""Whether every character is assigned; null of null."""
    return ~F.rlike(val(s), F.lit(r"\p{Cn}"))
