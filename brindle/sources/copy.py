"""COPY: tables from and to files of text, CSV or the binary format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_bad_record"
#: What begins a binary file.  Fixed value.
SIGNATURE = b"PGCOPY\n\xff\r\n\0"


def _schema(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def copy_from(spark: SparkSession, path: str, schema: str | T.StructType, *, format: str = "text", header: bool | str = False, delimiter: str | None = None, null: str | None = None, quote: str = '"', escape: str | None = None, default: str | None = None, defaults: dict[str, Column] | None = None, columns: list[str] | None = None, where: str | None = None, on_error: str = "stop", reject_limit: int | None = None, encoding: str = "UTF-8", line_ends: bool = True) -> DataFrame:
    """COPY FROM.

    text: tab-separated, \\N for null, backslash escapes.  csv: quoted fields may hold line ends; an unquoted empty
    field is null and a quoted one is empty text, so "NULL" and NULL differ if null is 'NULL'.  binary: the binary
    format.  header may be "match", which checks the names.  default is the text that stands for a column's default.
    on_error "ignore" leaves out rows that can't be read, up to reject_limit of them; "stop" raises.  A CSV file is read
    by one task, as a line end may stand in any field; say line_ends=False of files without such, and large ones are
    split.
    """
    schema = _schema(schema)
    if format == "binary":
        return _read_binary(spark, path, schema)
    names = columns or schema.fieldNames()
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if format == "csv":
        rows = _read_csv(spark, path, raw, header, delimiter or ",", quote, escape or quote, "" if null is None else null, encoding, line_ends)
    else:
        rows = _read_text(spark, path, raw, header, delimiter or "\t", r"\N" if null is None else null, encoding)
    return _typed(rows, schema, names, default, defaults or {}, where, on_error, reject_limit)


def _read_csv(spark, path, raw, header, delimiter, quote, escape, null, encoding, line_ends=True) -> DataFrame:
    marked = T.StructType([*raw.fields, T.StructField(BAD, T.StringType())])
    reader = spark.read.schema(marked).options(sep=delimiter, quote=quote, escape=escape, multiLine=line_ends, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, encoding=encoding, nullValue="\0none", emptyValue="\0empty", header=str(bool(header)).lower(), enforceSchema=str(header != "match").lower())
    # a quoted empty field arrives as the mark, an unquoted one as null
    rows = reader.csv(path)
    clean = lambda c: F.when(F.col(c) == "\0empty", "").when(F.coalesce(F.col(c), F.lit("")) == null, F.lit(None)).otherwise(F.coalesce(F.col(c), F.lit("")))
    return rows.select(*(clean(c).alias(c) for c in raw.names), BAD)


#: Escapes of the text format.  Fixed values.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}


def _read_text(spark, path, raw, header, delimiter, null, encoding) -> DataFrame:
    lines = spark.read.option("encoding", encoding).text(path).filter(F.col("value") != "\\.")
    if header:
        first = lines.first()
        if header == "match" and first and first.value.split(delimiter) != raw.names:
            raise ValueError(f"header doesn't match: {first.value}")
        lines = lines.filter(F.col("value") != F.lit(first.value)) if first else lines
    parts = F.split("value", f"(?<=(?<!\\\\)(?:\\\\\\\\){{0,50}})\\Q{delimiter}\\E", -1)

    def text(c: Column) -> Column:
        # a doubled backslash is put aside, so that what follows it isn't taken for an escape
        out = F.replace(c, F.lit("\\\\"), F.lit("\0"))
        for k, v in _ESCAPES.items():
            out = F.replace(out, F.lit("\\" + k), F.lit(v))
        out = F.regexp_replace(out, r"\\(.)", "$1")
        return F.when(c == null, F.lit(None)).otherwise(F.replace(out, F.lit("\0"), F.lit("\\")))

    wrong = F.size(parts) != len(raw.names)
    return lines.select(*(text(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(raw.names)), F.when(wrong, F.col("value")).alias(BAD))


def _typed(rows, schema, names, default, defaults, where, on_error, reject_limit) -> DataFrame:
    bad = F.col(BAD).isNotNull()
    out = []
    for f in schema.fields:
        if f.name not in names:
            out.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        kind = f.dataType
        made = F.unhex(F.regexp_replace(c, r"^\\x", "")) if isinstance(kind, T.BinaryType) else F.when(c.isin("t", "true", "1", "y", "yes", "on"), True).when(c.isin("f", "false", "0", "n", "no", "off"), False) if isinstance(kind, T.BooleanType) else c.try_cast(kind)
        is_default = c == default if default is not None else F.lit(False)
        if not isinstance(kind, T.StringType):
            bad = bad | (c.isNotNull() & ~F.coalesce(is_default, F.lit(False)) & made.isNull())
        out.append((F.when(is_default, defaults.get(f.name, F.lit(None)).cast(kind)).otherwise(made) if default is not None else made).alias(f.name))
    marked = rows.withColumn("__bad", bad)
    if on_error == "stop":
        line = F.concat_ws(",", *(F.coalesce(F.col(n), F.lit("")) for n in names))
        marked = marked.filter(F.when(F.col("__bad"), F.raise_error(F.concat(F.lit("invalid input: "), line))).otherwise(F.lit(True)))
    else:
        if reject_limit is not None and marked.filter("__bad").limit(reject_limit + 1).count() > reject_limit:
            raise ValueError(f"skipped more than REJECT_LIMIT ({reject_limit}) rows")
        marked = marked.filter("NOT __bad")
    found = marked.select(*out)
    return found.filter(where) if where else found


def rejected(spark: SparkSession, path: str, schema: str | T.StructType, **options: Any) -> DataFrame:
    """The rows that on_error "ignore" leaves out, as texts."""
    schema = _schema(schema)
    raw = T.StructType([T.StructField(n, T.StringType()) for n in schema.fieldNames()])
    rows = _read_csv(spark, path, raw, options.get("header", False), options.get("delimiter", ","), '"', '"', options.get("null", ""), "UTF-8")
    bad = F.col(BAD).isNotNull()
    for f in schema.fields:
        if not isinstance(f.dataType, T.StringType):
            bad = bad | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    return rows.filter(bad).drop(BAD)


def copy_to(df: DataFrame, path: str, *, format: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None, quote: str = '"', escape: str | None = None, force_quote: list[str] | None = None) -> None:
    """COPY TO a folder of files, one a task."""
    if format == "csv":
        null = "" if null is None else null
        q, e, sep = quote, escape or quote, delimiter or ","

        def field(c: str) -> Column:
            text = _output(df, c)
            needs = F.contains(text, F.lit(sep)) | F.contains(text, F.lit(q)) | text.rlike("[\r\n]") | (text == null)
            quoted = F.concat(F.lit(q), F.replace(F.replace(text, F.lit(e), F.lit(e + e)) if e != q else text, F.lit(q), F.lit(e + q)), F.lit(q))
            return F.when(text.isNull(), null).when(F.lit(c in (force_quote or ())) | needs, quoted).otherwise(text)

        lines = df.select(F.concat_ws(sep, *(field(c) for c in df.columns)).alias("value"))
        head = sep.join(df.columns)
    else:
        sep, null = delimiter or "\t", r"\N" if null is None else null

        def field(c: str) -> Column:
            text = F.replace(_output(df, c), F.lit("\\"), F.lit("\\\\"))
            for k, v in {**_ESCAPES, sep: sep}.items():
                text = F.replace(text, F.lit(v), F.lit("\\" + k)) if k in _ESCAPES or sep not in _ESCAPES.values() else text
            return F.coalesce(text, F.lit(null))

        lines = df.select(F.concat_ws(sep, *(field(c) for c in df.columns)).alias("value"))
        head = sep.join(df.columns)
    if header:
        lines = df.sparkSession.createDataFrame([(head,)], "value string").unionByName(lines)
    lines.write.text(path)


def _output(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(F.col(c), "t").when(~F.col(c), "f")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
    return F.col(c).cast("string")


# The binary format: a signature, flags, rows of length-prefixed fields in network order, -1 at the end

_PACK = {"smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d", "boolean": ">?"}


def pack_rows(rows: list[tuple], kinds: list[str]) -> bytes:
    out = [SIGNATURE, struct.pack(">ii", 0, 0)]
    for r in rows:
        out.append(struct.pack(">h", len(r)))
        for x, k in zip(r, kinds, strict=True):
            raw = None if x is None else struct.pack(_PACK[k], x) if k in _PACK else x if isinstance(x, bytes) else str(x).encode()
            out.append(struct.pack(">i", -1) if raw is None else struct.pack(">i", len(raw)) + raw)
    out.append(struct.pack(">h", -1))
    return b"".join(out)


def unpack_rows(raw: bytes, kinds: list[str]) -> Iterator[tuple]:
    if not raw.startswith(SIGNATURE):
        raise ValueError("COPY file signature not recognized")
    at = len(SIGNATURE) + 4
    at += 4 + struct.unpack_from(">i", raw, at)[0]
    while (n := struct.unpack_from(">h", raw, at)[0]) != -1:
        at += 2
        if n != len(kinds):
            raise ValueError(f"row field count is {n}, expected {len(kinds)}")
        row = []
        for k in kinds:
            size = struct.unpack_from(">i", raw, at)[0]
            at += 4
            if size < 0:
                row.append(None)
                continue
            body = raw[at : at + size]
            at += size
            row.append(struct.unpack(_PACK[k], body)[0] if k in _PACK else body if k == "binary" else body.decode())
        yield tuple(row)


def _read_binary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    kinds = [f.dataType.simpleString() for f in schema.fields]
    names = schema.fieldNames()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.content:
                yield pd.DataFrame(list(unpack_rows(bytes(raw), kinds)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)
