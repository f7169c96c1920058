"""Foreign tables: servers with options, and tables whose rows a data source of Spark reads where they are.

Wrappers are names for formats: files of CSV, text, JSON, Parquet or ORC, and databases by JDBC, which get the columns
and filters of a query as their own.  Nothing is read before a query runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from brindle.plans.dialect import TYPES, Token, _closing, _find, _is, _split, _text, tokens_of

#: Wrapper names and Spark's formats.
WRAPPERS = {"file_fdw": "csv", "csv": "csv", "text": "text", "json": "json", "parquet": "parquet", "orc": "orc", "postgres_fdw": "jdbc", "jdbc": "jdbc"}


@dataclass
class Server:
    wrapper: str
    options: dict[str, str]


def _name(t: Token) -> str:
    return t[1][1:-1].replace('""', '"') if t[0] == "quoted" else t[1].lower()


def _options(tokens: list[Token]) -> dict[str, str]:
    """OPTIONS (name 'value', ...)."""
    at = _find(tokens, "options")
    if at < 0:
        return {}
    return {_name(x[0]): x[1][1][1:-1].replace("''", "'") for x in _split(tokens[at + 2 : _closing(tokens, at + 1)])}


def _column(tokens: list[Token]) -> str:
    words = [t for t in tokens[1:] if not _is(t, "not", "null")]
    kind = _text(words).lower()
    plain, _, size = kind.partition("(")
    known = {"double precision": "double"}.get(plain.strip(), TYPES.get(plain.strip(), plain.strip()))
    return f"`{_name(tokens[0])}` {f'decimal({size}' if size and known.startswith('decimal') else known}"


class ForeignTables:
    """Servers and foreign tables of a session; a table is a temporary view."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.servers, self.tables = spark, {}, {}

    def create_server(self, name: str, wrapper: str, **options: str) -> None:
        if wrapper not in WRAPPERS:
            raise ValueError(f'foreign-data wrapper "{wrapper}" does not exist')
        self.servers[name] = Server(wrapper, options)

    def create_table(self, name: str, server: str, schema: str | None = None, **options: str) -> DataFrame:
        """A table on a server: with ``filename`` or ``path`` of files, or ``table_name`` in a database."""
        if server not in self.servers:
            raise ValueError(f'server "{server}" does not exist')
        at = self.servers[server]
        given = {**at.options, **options}
        kind = given.pop("format", WRAPPERS[at.wrapper])
        path = given.pop("filename", given.pop("path", None))
        if kind == "jdbc":
            schema_name, table = given.pop("schema_name", None), given.pop("table_name", name)
            given["dbtable"] = f"{schema_name}.{table}" if schema_name else table
            if "url" not in given:
                given["url"] = f"jdbc:postgresql://{given.pop('host', 'localhost')}:{given.pop('port', '5432')}/{given.pop('dbname', 'postgres')}"
            schema = None
        if kind == "csv":
            given = {"sep": given.pop("delimiter", ","), "nullValue": given.pop("null", ""), "escape": given.pop("escape", '"'), "emptyValue": "", **given}
        reader = self.spark.read.format(kind).options(**given)
        rows = (reader.schema(schema) if schema else reader).load(*([path] if path else []))
        rows.createOrReplaceTempView(name)
        self.tables[name] = rows
        return rows

    def drop_table(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def sql(self, text: str) -> None:
        """CREATE SERVER, CREATE FOREIGN TABLE, DROP FOREIGN TABLE and DROP SERVER."""
        tokens = [t for t in tokens_of(text) if not _is(t, ";")]
        words = [t[1].lower() for t in tokens[:3]]
        if words[:2] == ["create", "server"]:
            wrapper = _find(tokens, "wrapper")
            return self.create_server(_name(tokens[2]), _name(tokens[wrapper + 1]), **_options(tokens))
        if words == ["create", "foreign", "table"]:
            name, end = _name(tokens[3]), _closing(tokens, 4)
            server = _find(tokens, "server", start=end)
            schema = ", ".join(_column(c) for c in _split(tokens[5:end]))
            self.create_table(name, _name(tokens[server + 1]), schema or None, **_options(tokens[end:]))
        elif words == ["drop", "foreign", "table"]:
            self.drop_table(_name(tokens[3]))
        elif words[:2] == ["drop", "server"]:
            del self.servers[_name(tokens[2])]
        else:
            raise ValueError(f"not a statement on foreign tables: {text[:40]}")
        return None
