"""Catalog views over the session's tables: a small information_schema and pg_catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.functions.misc import TYPE_NAMES


def _name(kind: str) -> str:
    if kind.startswith("array<"):
        return "ARRAY"
    return "numeric" if kind.startswith("decimal") else "USER-DEFINED" if kind.startswith("struct") else TYPE_NAMES.get(kind, kind)


def tables(spark: SparkSession) -> DataFrame:
    """information_schema.tables."""
    rows = [(t.catalog, ".".join(t.namespace) if t.namespace else None, t.name, "VIEW" if t.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_catalog string, table_schema string, table_name string, table_type string")


def columns(spark: SparkSession, *names: str) -> DataFrame:
    """information_schema.columns of the named tables, by default all."""
    rows = []
    for n in names or [t.name for t in spark.catalog.listTables()]:
        for i, c in enumerate(spark.catalog.listColumns(n), 1):
            rows.append((n, c.name, i, "YES" if c.nullable else "NO", _name(c.dataType)))
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")


def pg_tables(spark: SparkSession) -> DataFrame:
    return tables(spark).filter("table_type = 'BASE TABLE'").selectExpr("table_schema AS schemaname", "table_name AS tablename")


def pg_class(spark: SparkSession) -> DataFrame:
    return tables(spark).selectExpr("table_name AS relname", "CASE table_type WHEN 'VIEW' THEN 'v' ELSE 'r' END AS relkind")


def pg_type(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in dict.fromkeys(TYPE_NAMES.values())], "typname string")


def keywords(spark: SparkSession) -> DataFrame:
    """pg_get_keywords: the words that SQL reserves (R) or not (U), as the parser has them."""
    return spark.sql("SELECT lower(keyword) AS word, CASE WHEN reserved THEN 'R' ELSE 'U' END AS catcode FROM sql_keywords()")


def register_views(spark: SparkSession) -> None:
    """As temporary views information_schema_tables, information_schema_columns, pg_tables, pg_class and pg_type."""
    frames = {"information_schema_tables": tables(spark), "information_schema_columns": columns(spark), "pg_tables": pg_tables(spark), "pg_class": pg_class(spark), "pg_type": pg_type(spark)}
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
