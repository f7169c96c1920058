"""String functions with PostgreSQL semantics."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.base import col, fail_if, val


def ascii(s):
    """Code point of the first character, 0 for the empty text."""
    s = col(s)
    code = F.conv(F.hex(F.encode(F.substring(s, 1, 1), "utf-32")), 16, 10).cast("int")
    return F.when(F.length(s) == 0, 0).otherwise(code)


def bit_length(s):
    return F.bit_length(col(s))


def octet_length(s):
    return F.octet_length(col(s))


def char_length(s):
    return F.char_length(col(s))


length = character_length = char_length


def lower(s):
    return F.lower(col(s))


def upper(s):
    return F.upper(col(s))


casefold = lower


def chr(n):
    """The character with a code point; 0 and what isn't a character raise."""
    n = col(n)
    made = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "utf-32")
    return fail_if((n <= 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "requested character is not valid", made)


def _trim(s, chars, left: bool, right: bool):
    s, chars = col(s), val(" " if chars is None else chars)
    if left and right:
        return F.btrim(s, chars)
    return F.ltrim(s, chars) if left else F.rtrim(s, chars)


def btrim(s, chars=None):
    return _trim(s, chars, True, True)


def ltrim(s, chars=None):
    return _trim(s, chars, True, False)


def rtrim(s, chars=None):
    return _trim(s, chars, False, True)


def concat(*args):
    """All arguments as text, nulls left out."""
    return F.concat_ws("", *(val(a).cast("string") for a in args))


def concat_ws(separator: str, *args):
    return F.concat_ws(separator, *(val(a).cast("string") for a in args))


def encode(b, form: str):
    b = col(b).cast("binary")
    if form == "hex":
        return F.lower(F.hex(b))
    if form == "base64":
        # lines of 76 characters, as MIME has them
        return F.regexp_replace(F.regexp_replace(F.base64(b), r"\s", ""), "(.{76})(?=.)", "$1\n")
    if form == "escape":
        return _escape(b)
    raise ValueError(f"unrecognized encoding: {form}")


def decode(s, form: str):
    s = col(s)
    if form == "hex":
        return F.unhex(F.regexp_replace(s, r"\s", ""))
    if form == "base64":
        return F.unbase64(F.regexp_replace(s, r"\s", ""))
    if form == "escape":
        return _unescape(s)
    raise ValueError(f"unrecognized encoding: {form}")


@F.pandas_udf(T.StringType())
def _escape(b: pd.Series) -> pd.Series:
    def one(x):
        return None if x is None else "".join("\\\\" if c == 92 else f"\\{c:03o}" if c == 0 or c > 127 else f"{c:c}" for c in x)

    return b.map(one)


@F.pandas_udf(T.BinaryType())
def _unescape(s: pd.Series) -> pd.Series:
    def one(x):
        if x is None:
            return None
        return re.sub(rb"\\(\\|[0-7]{3})", lambda m: b"\\" if m[1] == b"\\" else bytes([int(m[1], 8) & 255]), x.encode())

    return s.map(one)


def quote_ident(s):
    s = col(s)
    plain = s.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(s):
    s = col(s).cast("string")
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    quoted = F.concat(F.lit("'"), doubled, F.lit("'"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit(" E'"), F.replace(doubled, F.lit("\\"), F.lit("\\\\")), F.lit("'"))).otherwise(quoted)


def quote_nullable(s):
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def format(pattern: str, *args):
    """%s, %I, %L and %%, with positions as in %2$s and widths as in %-10s."""
    parts, last, following = [], 0, 0
    for m in re.finditer(r"%(?:%|(?:(\d+)\$)?(-)?(\d+)?([sIL]))", pattern):
        parts.append(F.lit(pattern[last : m.start()]))
        last = m.end()
        if m[0] == "%%":
            parts.append(F.lit("%"))
            continue
        at = int(m[1]) - 1 if m[1] else following
        following = at + 1
        if at >= len(args):
            raise ValueError("too few arguments for format()")
        arg = val(args[at]).cast("string")
        text = {"s": F.coalesce(arg, F.lit("")), "I": quote_ident(arg), "L": quote_nullable(arg)}[m[4]]
        if m[3]:
            padded = F.rpad(text, int(m[3]), " ") if m[2] else F.lpad(text, int(m[3]), " ")
            text = F.when(F.length(text) >= int(m[3]), text).otherwise(padded)
        parts.append(text)
    parts.append(F.lit(pattern[last:]))
    return F.concat(*parts)


def initcap(s):
    """Upper case after anything but a letter or digit, lower case elsewhere."""
    s = F.lower(col(s))
    chars = F.split(s, "")
    word = lambda c: c.rlike(r"^[\p{L}\p{N}]$")
    # an array is counted from 1, the lambda's index from 0: element i is the character before
    up = F.transform(chars, lambda c, i: F.when((i == 0) | ~word(F.coalesce(F.try_element_at(chars, F.greatest(i, F.lit(1))), F.lit(" "))), F.upper(c)).otherwise(c))
    return F.when(s == "", s).otherwise(F.array_join(up, ""))


def left(s, n):
    """The first n characters; without the last -n if n is negative."""
    s, n = col(s), val(n)
    return F.substr(s, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0))))


def right(s, n):
    s, n = col(s), val(n)
    keep = F.when(n >= 0, F.least(n, F.length(s))).otherwise(F.greatest(F.length(s) + n, F.lit(0)))
    return F.when(keep == 0, F.lit("")).otherwise(F.substr(s, F.length(s) - keep + 1, keep))


def lpad(s, n, fill=" "):
    s, n = col(s), val(n)
    return F.when(n <= 0, F.lit("")).when(val(fill) == "", F.substr(s, F.lit(1), n)).otherwise(F.lpad(s, n, val(fill)))


def rpad(s, n, fill=" "):
    s, n = col(s), val(n)
    return F.when(n <= 0, F.lit("")).when(val(fill) == "", F.substr(s, F.lit(1), n)).otherwise(F.rpad(s, n, val(fill)))


def md5(s):
    return F.md5(col(s).cast("binary"))


def overlay(s, new, start, count=None):
    s, new, start = col(s), val(new), val(start)
    count = F.length(new) if count is None else val(count)
    return F.concat(F.substr(s, F.lit(1), start - 1), new, F.substr(s, start + count, F.length(s)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parse_ident(s: pd.Series, strict: pd.Series) -> pd.Series:
    part = re.compile(r'\s*(?:"((?:[^"]|"")+)"|([^\W\d][\w$]*))\s*')

    def one(x, strictly):
        if x is None:
            return None
        out, at = [], 0
        while m := part.match(x, at):
            out.append(m[1].replace('""', '"') if m[1] is not None else m[2].lower())
            at = m.end()
            if at < len(x) and x[at] == ".":
                at += 1
                if at == len(x):
                    raise ValueError(f'string is not a valid identifier: "{x}"')
            else:
                break
        if not out or strictly and at < len(x):
            raise ValueError(f'string is not a valid identifier: "{x}"')
        return out

    return pd.Series([one(x, b) for x, b in zip(s, strict, strict=True)])


def parse_ident(s, strict: bool = True):
    return _parse_ident(col(s), F.lit(strict))


def strpos(s, part):
    """Where a part first occurs, counted from 1; 0 if nowhere, 1 for the empty part."""
    return F.instr(col(s), val(part))


position = strpos


def repeat(s, n):
    return F.repeat(col(s), F.greatest(val(n), F.lit(0)))


def replace(s, old, new):
    s, old = col(s), val(old)
    return F.when(old == "", s).otherwise(F.replace(s, old, val(new)))


def reverse(s):
    return F.reverse(col(s))


def reverse_bytes(b):
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.hex(col(b)), F.lit("(..)"), 1)), ""))


def split_part(s, separator, n):
    s, separator, n = col(s), val(separator), val(n)
    whole = F.when(F.abs(n) == 1, s).otherwise(F.lit(""))
    found = F.when(separator == "", whole).otherwise(F.split_part(s, separator, F.when(n == 0, 1).otherwise(n)))
    return fail_if(n == 0, "field position must not be zero", found)


def starts_with(s, part):
    return F.startswith(col(s), val(part))


def string_to_array(s, separator, null_string=None):
    """Parts between separators: characters if the separator is null, the whole text if it is empty."""
    s = col(s)
    if separator is None:
        parts = F.filter(F.split(s, ""), lambda x: x != "")
    elif separator == "":
        parts = F.array(s)
    else:
        parts = F.split(s, f"\\Q{separator}\\E", -1)
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(parts)
    if null_string is not None:
        parts = F.transform(parts, lambda x: F.when(x == null_string, F.lit(None)).otherwise(x))
    return F.when(s.isNotNull(), parts)


def substr(s, start, count=None):
    """From a place counted from 1; places before the text count but hold nothing; a negative count raises."""
    s, start = col(s), val(start)
    if count is None:
        return F.substr(s, F.greatest(start, F.lit(1)), F.length(s))
    count = val(count)
    keep = F.greatest(F.lit(0), F.when(start < 1, count + start - 1).otherwise(count)).cast("int")
    return fail_if(count < 0, "negative substring length not allowed", F.substr(s, F.greatest(start, F.lit(1)), keep))


substring = substr


def java_regex(pattern: str, flags: str = "") -> str:
    """A pattern with inline flags: i ignores case, n and s and x as in the pattern language; c and g aren't part of it."""
    inline = ""
    for f in flags:
        if f in "ix":
            inline += f
        elif f in "nm":
            inline += "m"
        elif f == "s":
            inline += "s"
        elif f == "c":
            inline = inline.replace("i", "")
        elif f != "g":
            raise ValueError(f'invalid regular expression option: "{f}"')
    return f"(?{inline}){pattern}" if inline else pattern


def substring_regex(s, pattern: str):
    """The first match, or its first group if the pattern has one; null if there is none."""
    s = col(s)
    group = 1 if re.compile(pattern).groups else 0
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def regexp_match(s, pattern: str, flags: str = ""):
    """Array of the first match's groups, or of the match; null if there is none."""
    s, p = col(s), java_regex(pattern, flags)
    groups = re.compile(pattern).groups
    return F.when(s.rlike(p), F.array(*(F.regexp_extract(s, p, i) for i in (range(1, groups + 1) if groups else (0,)))))


def regexp_matches(s, pattern: str, flags: str = ""):
    """Rows of such arrays, as an array: the first, or with g all."""
    s, p = col(s), java_regex(pattern, flags)
    groups = re.compile(pattern).groups
    if "g" not in flags:
        found = regexp_match(s, pattern, flags)
        return F.when(found.isNotNull(), F.array(found)).otherwise(F.array().cast("array<array<string>>"))
    each = [F.regexp_extract_all(s, F.lit(p), i) for i in (range(1, groups + 1) if groups else (0,))]
    return F.transform(each[0], lambda x, i: F.array(*(F.get(e, i) for e in each)))


def regexp_like(s, pattern: str, flags: str = ""):
    return col(s).rlike(java_regex(pattern, flags))


def regexp_count(s, pattern: str, start: int = 1, flags: str = ""):
    return F.regexp_count(substr(s, start), F.lit(java_regex(pattern, flags)))


def regexp_replace(s, pattern: str, new: str, flags: str = ""):
    """The first match only, unless flags have g.  Groups in the replacement are written \\1, the match \\&."""
    s, p = col(s), java_regex(pattern, flags)
    new = re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$").replace("\\&", "$0"))
    if "g" in flags:
        return F.regexp_replace(s, p, new)
    # text before the first match and the match; the rest stays
    return F.regexp_replace(s, f"(?s)^(?<pgHead>.*?)(?:{p})(?<pgTail>.*)$", "${pgHead}" + _shifted(new) + "${pgTail}") if "$" in new else F.regexp_replace(s, f"(?s)^(?<pgHead>.*?)(?:{p})(?<pgTail>.*)$", "${pgHead}" + new + "${pgTail}")


def _shifted(new: str) -> str:
    """Groups of the pattern stand one further right behind the head."""
    return re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 1}", new)


def regexp_split_to_array(s, pattern: str, flags: str = ""):
    return F.split(col(s), java_regex(pattern, flags), -1)


def regexp_substr(s, pattern: str, flags: str = ""):
    s, p = col(s), java_regex(pattern, flags)
    return F.when(s.rlike(p), F.regexp_extract(s, p, 0))


def regexp_instr(s, pattern: str):
    return F.regexp_instr(col(s), F.lit(pattern))


def similar_regex(pattern: str, escape: str = "\\") -> str:
    """A SIMILAR TO pattern as a Java one."""
    out, i, bracket = "", 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif bracket:
            bracket = ch != "]"
            out += ch
        elif ch == "[":
            bracket = True
            out += ch
        elif ch == "%":
            out += ".*"
        elif ch == "_":
            out += "."
        elif ch in ".^$\\":
            out += "\\" + ch
        else:
            out += ch
        i += 1
    return f"(?s)^(?:{out})$"


def similar_to(s, pattern: str, escape: str = "\\"):
    return col(s).rlike(similar_regex(pattern, escape))


def ilike(s, pattern: str):
    return col(s).ilike(pattern)


def like(s, pattern: str):
    return col(s).like(pattern)


def regex_match(s, pattern: str):
    """The operator ~."""
    return col(s).rlike(pattern)


def regex_match_ci(s, pattern: str):
    """The operator ~*."""
    return col(s).rlike("(?i)" + pattern)


def to_hex(n):
    return F.lower(F.hex(col(n)))


def to_bin(n):
    return F.bin(col(n))


def to_oct(n):
    return F.conv(col(n).cast("string"), 10, 8)


def translate(s, old: str, new: str):
    """Characters of old by those of new at the same place; the first of repeated ones counts."""
    seen, a, b = set(), "", ""
    for i, ch in enumerate(old):
        if ch not in seen:
            seen.add(ch)
            a += ch
            b += new[i] if i < len(new) else ""
    # those without a partner are deleted, so they go last
    paired = [ch for ch in a if old.index(ch) < len(new)]
    rest = [ch for ch in a if old.index(ch) >= len(new)]
    return F.translate(col(s), "".join(paired + rest), "".join(new[old.index(ch)] for ch in paired))


# Hashes of texts by Bob Jenkins' lookup3, with the start value PostgreSQL uses.


def _mix(a: int, b: int, c: int) -> tuple[int, int, int]:
    m = 0xFFFFFFFF
    rot = lambda x, k: (x << k | x >> (32 - k)) & m
    for k1, k2, k3 in ((4, 6, 8), (16, 19, 4)):
        a = (a - c & m) ^ rot(c, k1)
        c = c + b & m
        b = (b - a & m) ^ rot(a, k2)
        a = a + c & m
        c = (c - b & m) ^ rot(b, k3)
        b = b + a & m
    return a, b, c


def _lookup3(key: bytes, seed: int) -> tuple[int, int]:
    m = 0xFFFFFFFF
    a = b = c = (0x9E3779B9 + len(key) + 3923095) & m
    if seed:
        a, b = a + (seed >> 32) & m, b + (seed & m) & m
        a, b, c = _mix(a, b, c)
    at = 0
    word = lambda i: int.from_bytes(key[i : i + 4], "little")
    while len(key) - at >= 12:
        a, b, c = _mix(a + word(at) & m, b + word(at + 4) & m, c + word(at + 8) & m)
        at += 12
    rest = key[at:]
    a = a + int.from_bytes(rest[:4], "little") & m
    b = b + int.from_bytes(rest[4:8], "little") & m
    # the lowest byte of c is taken by the length
    c = c + (int.from_bytes(rest[8:12], "little") << 8) & m
    rot = lambda x, k: (x << k | x >> (32 - k)) & m
    c = (c ^ b) - rot(b, 14) & m
    a = (a ^ c) - rot(c, 11) & m
    b = (b ^ a) - rot(a, 25) & m
    c = (c ^ b) - rot(b, 16) & m
    a = (a ^ c) - rot(c, 4) & m
    b = (b ^ a) - rot(a, 14) & m
    c = (c ^ b) - rot(b, 24) & m
    return b, c


@F.pandas_udf(T.IntegerType())
def _hashtext(s: pd.Series) -> pd.Series:
    signed = lambda x: x - (1 << 32) if x >> 31 else x
    return pd.Series([None if x is None else signed(_lookup3(x.encode(), 0)[1]) for x in s], dtype="Int32")


@F.pandas_udf(T.LongType())
def _hashtextextended(s: pd.Series, seed: pd.Series) -> pd.Series:
    def one(x, k):
        b, c = _lookup3(x.encode(), int(k) & (1 << 64) - 1)
        h = b << 32 | c
        return h - (1 << 64) if h >> 63 else h

    return pd.Series([None if x is None or k is None else one(x, k) for x, k in zip(s, seed, strict=True)], dtype="Int64")


def hashtext(s) -> Column:
    return _hashtext(col(s))


def hashtextextended(s, seed=0) -> Column:
    return _hashtextextended(col(s), val(seed).cast("long"))
