"""Digests, ciphers, identifiers, XML, bits, addresses and session functions."""

from __future__ import annotations

import os
import time
import uuid
import zlib
from xml.sax import saxutils

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.base import col, val

# Digests and ciphers


def digest(x, kind: str) -> Column:
    b = col(x).cast("binary")
    of = {"md5": lambda: F.md5(b), "sha1": lambda: F.sha1(b), "sha224": lambda: F.sha2(b, 224), "sha256": lambda: F.sha2(b, 256), "sha384": lambda: F.sha2(b, 384), "sha512": lambda: F.sha2(b, 512)}
    return F.unhex(of[kind.lower()]())


#: Bytes of a block of each hash, for hmac.
_BLOCKS = {"md5": 64, "sha1": 64, "sha224": 64, "sha256": 64, "sha384": 128, "sha512": 128}


def hmac(x, key: str | bytes, kind: str) -> Column:
    """Keyed digest, from two plain ones over the key padded to a block."""
    block = _BLOCKS[kind.lower()]
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) > block:
        import hashlib

        raw = hashlib.new(kind.lower(), raw).digest()
    raw = raw.ljust(block, b"\0")
    pad = lambda byte: F.lit(bytes(c ^ byte for c in raw))
    inner = digest(F.concat(pad(0x36), col(x).cast("binary")), kind)
    return digest(F.concat(pad(0x5C), inner), kind)


def encrypt(x, key: bytes, kind: str = "aes") -> Column:
    return _cipher(F.aes_encrypt, x, key, kind)


def decrypt(x, key: bytes, kind: str = "aes") -> Column:
    return _cipher(F.aes_decrypt, x, key, kind)


def _cipher(f, x, key: bytes, kind: str) -> Column:
    mode = "ECB" if "ecb" in kind else "CBC"
    if mode == "ECB":
        return f(col(x).cast("binary"), F.lit(key), F.lit("ECB"), F.lit("PKCS"))
    # without a start block it is zero; the engine writes the block in front of the text, the dialect doesn't
    return _cbc(f, x, key, bytes(16))


def _cbc(f, x, key: bytes, start: bytes) -> Column:
    b = col(x).cast("binary")
    if f is F.aes_encrypt:
        return F.substring(F.aes_encrypt(b, F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(start)), 17, 1 << 30)
    return F.aes_decrypt(F.concat(F.lit(start), b), F.lit(key), F.lit("CBC"), F.lit("PKCS"))


def encrypt_iv(x, key: bytes, start: bytes, kind: str = "aes") -> Column:
    return _cbc(F.aes_encrypt, x, key, start)


def decrypt_iv(x, key: bytes, start: bytes, kind: str = "aes") -> Column:
    return _cbc(F.aes_decrypt, x, key, start)


@F.pandas_udf(T.BinaryType())
def _random_bytes(n: pd.Series) -> pd.Series:
    return n.map(lambda k: None if pd.isna(k) else os.urandom(int(k)))


def gen_random_bytes(n) -> Column:
    return _random_bytes.asNondeterministic()(val(n))


def crc32(x) -> Column:
    return F.crc32(col(x).cast("binary"))


def _crc32c_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


@F.pandas_udf(T.LongType())
def _crc32c(x: pd.Series) -> pd.Series:
    table = _crc32c_table()

    def one(b):
        c = 0xFFFFFFFF
        for byte in b:
            c = c >> 8 ^ table[(c ^ byte) & 255]
        return c ^ 0xFFFFFFFF

    return x.map(lambda b: None if b is None else one(b)).astype("Int64")


def crc32c(x) -> Column:
    return _crc32c(col(x).cast("binary"))


def adler32(x) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda b: None if b is None else zlib.adler32(b)), T.LongType())(col(x).cast("binary"))


# Identifiers


def gen_random_uuid() -> Column:
    return F.uuid()


uuid_generate_v4 = gen_random_uuid

#: Namespaces that everyone knows.  Fixed values.
NAMESPACES = {"dns": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "url": "6ba7b811-9dad-11d1-80b4-00c04fd430c8", "oid": "6ba7b812-9dad-11d1-80b4-00c04fd430c8", "x500": "6ba7b814-9dad-11d1-80b4-00c04fd430c8"}


def _named(namespace, name, hash_, version: str) -> Column:
    space = F.unhex(F.replace(val(namespace).cast("string"), F.lit("-"), F.lit("")))
    h = F.substring(hash_(F.concat(space, col(name).cast("binary"))), 1, 32)
    # four bits are the version, two the variant
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit(version), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def uuid_generate_v3(namespace, name) -> Column:
    return _named(namespace, name, F.md5, "3")


def uuid_generate_v5(namespace, name) -> Column:
    return _named(namespace, name, F.sha1, "5")


def _made(f):
    made = F.pandas_udf(lambda x: pd.Series([f() for _ in range(len(x))]), T.StringType()).asNondeterministic()
    return lambda: made(F.rand())


uuid_generate_v1 = _made(lambda: str(uuid.uuid1()))
uuid_generate_v1mc = _made(lambda: str(uuid.uuid1(node=int.from_bytes(os.urandom(6), "big") | 1 << 40)))


def _v7() -> str:
    ms = time.time_ns() // 1_000_000
    n = ms << 80 | 7 << 76 | int.from_bytes(os.urandom(2), "big") % 4096 << 64 | 2 << 62 | int.from_bytes(os.urandom(8), "big") >> 2
    return str(uuid.UUID(int=n))


uuidv7 = _made(_v7)


def uuid_extract_version(u) -> Column:
    return F.when(F.substring(col(u), 20, 1).isin("8", "9", "a", "b"), F.conv(F.substring(col(u), 15, 1), 16, 10).cast("int"))


def uuid_extract_timestamp(u) -> Column:
    """The moment in a version 1 or 7 identifier; null for others."""
    u = col(u)
    h = F.replace(u, F.lit("-"), F.lit(""))
    v7 = F.timestamp_millis(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"))
    ticks = F.conv(F.concat(F.substring(h, 14, 3), F.substring(h, 9, 4), F.substring(h, 1, 8)), 16, 10).cast("long")
    # 100 ns ticks from 1582-10-15
    v1 = F.timestamp_micros(F.floor((ticks - 122192928000000000) / 10).cast("long"))
    version = uuid_extract_version(u)
    return F.when(version == 7, v7).when(version == 1, v1)


# XML


def _xml_text(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xmlelement(name: str, attributes: dict[str, Column] | None = None, *content) -> Column:
    given = [F.coalesce(F.concat(F.lit(f' {k}="'), F.replace(_xml_text(val(v)), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit("")) for k, v in (attributes or {}).items()]
    body = F.concat_ws("", *(_xml_text(val(c)) for c in content)) if content else F.lit("")
    head = F.concat(F.lit(f"<{name}"), *given)
    return F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{name}>")))


def xmlforest(**columns) -> Column:
    return F.concat_ws("", *(F.concat(F.lit(f"<{k}>"), _xml_text(val(v)), F.lit(f"</{k}>")) for k, v in columns.items()))


def xmlcomment(x) -> Column:
    x = val(x)
    bad = F.contains(x, F.lit("--")) | x.endswith("-")
    return F.when(bad, F.raise_error(F.lit("invalid XML comment"))).otherwise(F.concat(F.lit("<!--"), x, F.lit("-->")))


def xmlconcat(*parts) -> Column:
    return F.concat_ws("", *map(val, parts))


@F.pandas_udf(T.BooleanType())
def _well_formed(x: pd.Series, whole: pd.Series) -> pd.Series:
    from xml.etree import ElementTree

    def one(text, document):
        try:
            ElementTree.fromstring(text if document else f"<a>{text}</a>")
        except ElementTree.ParseError:
            return False
        return True

    return pd.Series([None if t is None else one(t, d) for t, d in zip(x, whole, strict=True)])


def xml_is_well_formed_document(x) -> Column:
    return _well_formed(col(x), F.lit(True))


def xml_is_well_formed_content(x) -> Column:
    return _well_formed(col(x), F.lit(False))


xml_is_well_formed = xml_is_well_formed_content


def xmlparse(x, document: bool = False) -> Column:
    """The text itself if it is well-formed; else an error."""
    return F.when(_well_formed(col(x), F.lit(document)), col(x)).otherwise(F.raise_error(F.lit("invalid XML")))


def xml_unescape(text: str) -> str:
    return saxutils.unescape(text, {"&quot;": '"', "&apos;": "'"})


# Bits as text


def _bits(x) -> Column:
    return F.filter(F.split(val(x), ""), lambda c: c != "")


def bit_and(a, b) -> Column:
    return F.array_join(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0")), "")


def bit_or(a, b) -> Column:
    return F.array_join(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0")), "")


def bit_xor(a, b) -> Column:
    return F.array_join(F.zip_with(_bits(a), _bits(b), lambda x, y: F.when(x != y, "1").otherwise("0")), "")


def bit_not(a) -> Column:
    return F.translate(val(a), "01", "10")


def bit_count(x) -> Column:
    return F.length(F.replace(val(x), F.lit("0"), F.lit(""))).cast("long")


def get_bit(x, at) -> Column:
    """Bit at a place counted from 0 from the left."""
    return F.substr(val(x), val(at) + 1, F.lit(1)).cast("int")


def set_bit(x, at: int, bit: int) -> Column:
    x = val(x)
    return F.concat(F.substring(x, 1, at), F.lit(str(bit)), F.substr(x, F.lit(at + 2), F.length(x)))


# Network addresses as text


def host(x) -> Column:
    return F.split_part(col(x), F.lit("/"), F.lit(1))


def masklen(x) -> Column:
    x = col(x)
    given = F.regexp_extract(x, r"/(\d+)$", 1)
    return F.when(given != "", given).otherwise(F.when(F.contains(x, F.lit(":")), "128").otherwise("32")).cast("int")


def family(x) -> Column:
    return F.when(F.contains(col(x), F.lit(":")), 6).otherwise(4)


# Points


def point_add(a, b) -> Column:
    a, b = col(a), col(b)
    return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))


# Session and catalog


#: The dialect's names of Spark's types.  Fixed values.
TYPE_NAMES = {"int": "integer", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint", "string": "text", "double": "double precision", "float": "real", "boolean": "boolean", "binary": "bytea", "date": "date", "timestamp": "timestamp with time zone", "timestamp_ntz": "timestamp without time zone", "void": "unknown"}


def pg_typeof(x) -> Column:
    kind = F.typeof(val(x))
    array = F.regexp_extract(kind, "^array<(.*)>$", 1)
    named = lambda k: F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for p in TYPE_NAMES.items() for v in p)), k), F.when(k.startswith("decimal"), "numeric"), F.when(k.startswith("struct"), "record"), k)
    return F.when(array != "", F.concat(named(array), F.lit("[]"))).otherwise(named(kind))


def pg_input_is_valid(x, kind: str) -> Column:
    return col(x).try_cast(kind).isNotNull() | col(x).isNull()


def pg_column_size(x) -> Column:
    return F.octet_length(val(x).cast("string"))


def current_schemas(implicit: bool = False) -> Column:
    return F.array(*([F.lit("pg_catalog")] if implicit else []), F.current_schema())


def version() -> Column:
    return F.version()


current_user, session_user, current_database, current_schema, current_catalog = F.current_user, F.session_user, F.current_database, F.current_schema, F.current_catalog


xml = xmlparse
bitand = bit_and
point_pl = point_add
system_user = F.user
bool_and, bool_or = F.bool_and, F.bool_or


def record_eq(a, b) -> Column:
    """Records are equal if all fields are; nulls equal each other."""
    return col(a).eqNullSafe(col(b))


def text_eq(a, b) -> Column:
    return col(a) == val(b)
