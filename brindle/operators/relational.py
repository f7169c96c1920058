"""Relational operators that DataFrames lack or order differently."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Key = str | Column


def _col(x: Key) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asc(x: Key) -> Column:
    """Ascending, nulls last: the dialect's default."""
    return _col(x).asc_nulls_last()


def desc(x: Key) -> Column:
    """Descending, nulls first: the dialect's default."""
    return _col(x).desc_nulls_first()


def distinct_on(df: DataFrame, keys: Sequence[Key], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each group in an order; null keys form a group.

    The filter on the rank lets the planner keep one row a group in each task before the shuffle.
    """
    w = Window.partitionBy(*map(_col, keys)).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def with_ties(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES.

    The keys of the first n rows come from a top-n, which sends n rows a task; rows with one of those keys are the
    answer, found by a semi join with at most n keys, so no window runs over the whole table.
    """
    if n <= 0:
        return df.limit(0)
    names = [free_name(df.columns, f"key{i}") for i in range(len(order))]
    bare, sorts = zip(*(_taken_apart(o) for o in order), strict=True)
    keyed = df.withColumns(dict(zip(names, bare, strict=True)))
    top = keyed.orderBy(*(sort(F.col(k)) for sort, k in zip(sorts, names, strict=True))).limit(n).select(*names).distinct()
    top = F.broadcast(top.withColumnsRenamed({k: f"{k}_top" for k in names}))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_top")) for k in names))
    return keyed.join(top, same, "left_semi").drop(*names)


_SORTS = {"ASC NULLS FIRST": Column.asc_nulls_first, "ASC NULLS LAST": Column.asc_nulls_last, "DESC NULLS FIRST": Column.desc_nulls_first, "DESC NULLS LAST": Column.desc_nulls_last}


def _taken_apart(order: Column):
    """The expression of a sort order, and the function that makes the order of it."""
    text = order._jc.toString()
    for end, f in _SORTS.items():
        if text.endswith(" " + end):
            return F.expr(text.removesuffix(" " + end)), f
    return order, Column.asc_nulls_last


def free_name(taken: Sequence[str], wish: str) -> str:
    """A column name that no column has yet."""
    names = {x.lower() for x in taken}
    while wish.lower() in names:
        wish += "_"
    return wish


def limit_offset(df: DataFrame, order: Sequence[Column], n: int | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET; negative numbers raise."""
    if (n is not None and n < 0) or offset < 0:
        raise ValueError("LIMIT and OFFSET must not be negative")
    out = df.orderBy(*order)
    if n is not None:
        # a top-n of both, then the rows behind the offset
        out = out.limit(n + offset)
    return out.offset(offset) if offset else out


def not_in(df: DataFrame, key: Key, values: DataFrame, value: str) -> DataFrame:
    """NOT IN (subquery) in three-valued logic: any null among the values keeps no row, null keys are kept only if
    there are no values.

    An anti join by the key, whatever the sizes, and one row that says whether there are values and nulls among them.
    """
    own, some, nulls = (free_name(df.columns, x) for x in ("key", "some", "nulls"))
    listed = values.select(F.col(value).alias(own))
    about = listed.agg(F.count(F.lit(1)).alias(some), F.count_if(F.col(own).isNull()).alias(nulls))
    left = df.withColumn(own, _col(key)).join(listed.filter(F.col(own).isNotNull()), own, "left_anti")
    fits = (F.col(some) == 0) | (F.col(nulls) == 0) & F.col(own).isNotNull()
    return left.crossJoin(F.broadcast(about)).filter(fits).select(*(F.col(c) for c in df.columns))


def partial_index(table: DataFrame, where: Column, key: Sequence[str], include: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """A partial index: the rows that the predicate holds for, their key and included columns only, sorted by the key.

    It is a table of files; a query whose condition implies the predicate reads it in the table's stead, and filters
    on the key skip row groups by their least and greatest values.
    """
    from brindle.session import scratch

    path = path or scratch(table.sparkSession, "index")
    rows = table.filter(where).select(*dict.fromkeys([*key, *include]))
    rows.repartitionByRange(*key).sortWithinPartitions(*key).write.parquet(path)
    return table.sparkSession.read.schema(rows.schema).parquet(path)


def array_agg(x: Key, order: Sequence[Key] | None = None, distinct: bool = False) -> Column:
    """array_agg: nulls are kept; with an order, elements are put in it (ascending, nulls last)."""
    x = _col(x)
    if order:
        rows = F.array_sort(F.collect_list(F.struct(*(y for i, o in enumerate(order) for y in (_col(o).isNull().alias(f"n{i}"), _col(o).alias(f"o{i}"))), x.alias("x"))))
        out = F.transform(rows, lambda r: r["x"])
    else:
        out = F.transform(F.collect_list(F.struct(x.alias("x"))), lambda r: r["x"])
    if distinct:
        known = F.array_sort(F.array_distinct(out))
        return known
    return out


def string_agg(x: Key, separator: str, order: Sequence[Key] | None = None, distinct: bool = False) -> Column:
    """string_agg: nulls are left out; null if there is nothing else."""
    x = _col(x).cast("string")
    if distinct:
        found = F.array_sort(F.collect_set(x))
    elif order:
        rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(*(y for i, o in enumerate(order) for y in (_col(o).isNull().alias(f"n{i}"), _col(o).alias(f"o{i}"))), x.alias("x")))))
        found = F.transform(rows, lambda r: r["x"])
    else:
        found = F.collect_list(x)
    return F.when(F.size(found) > 0, F.array_join(found, separator))


def json_agg(x: Key, order: Sequence[Key] | None = None) -> Column:
    """json_agg: a JSON array, nulls kept."""
    from brindle.functions import jsons

    values = F.transform(array_agg(x, order), lambda v: F.coalesce(jsons.to_json(v), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def json_object_agg(key: Key, value: Key) -> Column:
    """json_object_agg, with keys in order."""
    from brindle.functions import jsons

    pairs = F.array_sort(F.collect_list(F.struct(_col(key).cast("string").alias("k"), _col(value).alias("v"))))
    one = F.transform(pairs, lambda p: F.concat(jsons.to_json(p["k"]), F.lit(": "), F.coalesce(jsons.to_json(p["v"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))


def sum_wide(x: Key) -> Column:
    """sum of a bigint as a numeric, which doesn't overflow."""
    return F.sum(_col(x).cast("decimal(20,0)"))


def avg_numeric(x: Key) -> Column:
    """avg of integers as a numeric."""
    return F.avg(_col(x).cast("decimal(20,0)"))


def mode(x: Key) -> Column:
    """mode() WITHIN GROUP: the most frequent value, of several the least."""
    return F.mode(_col(x), deterministic=True)


def percentile_cont(x: Key, p: float) -> Column:
    return F.percentile(_col(x), p)


def percentile_disc(df: DataFrame, keys: Sequence[str], x: str, ps: Sequence[float]) -> DataFrame:
    """percentile_disc of several shares by group."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({float(p)}D) WITHIN GROUP (ORDER BY `{x}`)").alias(f"p{i}") for i, p in enumerate(ps)))


def hypothetical_rank(x: Key, value: Any, descending: bool = False) -> Column:
    """rank(value) WITHIN GROUP (ORDER BY x)."""
    x = _col(x)
    return F.lit(1) + F.count_if(x > value if descending else x < value)


def hypothetical_dense_rank(x: Key, value: Any) -> Column:
    x = _col(x)
    return F.lit(1) + F.count_distinct(F.when(x < value, x))


def unnest(df: DataFrame, *arrays: str, names: Sequence[str] | None = None, ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """unnest of one or several arrays side by side, the shorter ones filled with nulls."""
    names = list(names or arrays)
    zipped = F.arrays_zip(*(F.col(a).alias(n) for a, n in zip(arrays, names, strict=True)))
    kept = [c for c in df.columns if c not in arrays and c not in names]
    explode = F.posexplode_outer if outer else F.posexplode
    rows = df.select(*kept, explode(zipped).alias("__at", "__row"))
    # without outer, arrays_zip of null arrays is null and gives no row
    out = rows.select(*kept, *(F.col(f"__row.{n}").alias(n) for n in names), *([(F.col("__at") + 1).cast("long").alias(ordinality)] if ordinality else []))
    return out


def generate_series(spark: SparkSession, start: Any, stop: Any, step: Any = 1, name: str = "generate_series") -> DataFrame:
    """Whole numbers from a distributed range; timestamps from a sequence by an interval text."""
    if isinstance(start, int):
        if step == 0:
            raise ValueError("step size cannot equal zero")
        n = (stop - start) // step + 1
        return spark.range(max(n, 0)).select((F.lit(start) + F.col("id") * step).alias(name))
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr(f"INTERVAL {step}"))).alias(name))


def generate_subscripts(df: DataFrame, array: str, name: str = "i", reverse: bool = False) -> DataFrame:
    places = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(name, F.explode(F.reverse(places) if reverse else places))


def rows_from(df: DataFrame, functions: dict[str, Column], ordinality: str | None = None) -> DataFrame:
    """ROWS FROM: several array-valued functions side by side, as rows."""
    for name, f in functions.items():
        df = df.withColumn(name, f)
    return unnest(df, *functions, ordinality=ordinality)


def values(spark: SparkSession, rows: Sequence[Sequence[Any]], names: Sequence[str]) -> DataFrame:
    """VALUES: rows with the common type of each column."""
    text = ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def _literal(x: Any) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(x, float):
        return f"{x!r}D"
    return str(x)


def inherited_scan(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """A parent table with the rows of its children, in the parent's columns."""
    out = parent
    for c in children:
        out = out.unionByName(c, allowMissingColumns=True)
    return out.select(*parent.columns)


def tablesample_system(df: DataFrame, percent: float) -> DataFrame:
    """TABLESAMPLE SYSTEM: only all of it can be asked for."""
    if percent != 100:
        raise ValueError("only TABLESAMPLE SYSTEM (100) is supported")
    return df


def group_by_primary_key(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """GROUP BY a primary key: the other columns depend on it and may be shown."""
    others = [F.first(c).alias(c) for c in df.columns if c != key]
    return df.groupBy(key).agg(*others, *aggregates)


# Set-returning functions: a row for each element, beside the row's other columns


def _exploded(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(array))


def json_array_elements(df: DataFrame, document: str, name: str = "value", text: bool = False) -> DataFrame:
    from brindle.functions import jsons

    return _exploded(df, (jsons.elements_text if text else jsons.elements)(document), name)


def json_each(df: DataFrame, document: str, text: bool = False) -> DataFrame:
    """Columns key and value of each member."""
    from brindle.functions import jsons

    rows = _exploded(df, (jsons.each_text if text else jsons.each)(document), "__pair")
    return rows.select(*df.columns, "__pair.key", "__pair.value")


def json_to_recordset(df: DataFrame, document: str, schema: str) -> DataFrame:
    """A row of typed columns for each object of an array."""
    rows = _exploded(df, F.from_json(document, f"array<struct<{schema}>>"), "__row")
    return rows.select(*df.columns, "__row.*")


def json_table(df: DataFrame, document: str, path: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """JSON_TABLE: for each thing that a path finds, columns of (type, path within it)."""
    from brindle.functions import jsons

    rows = _exploded(df, jsons.path_query(document, path), "__doc")
    return rows.select(*df.columns, *(jsons.json_value("__doc", p).try_cast(t).alias(c) for c, (t, p) in columns.items()))


def regexp_split_to_table(df: DataFrame, text: str, pattern: str, name: str = "part", flags: str = "") -> DataFrame:
    from brindle.functions import strings

    return _exploded(df, strings.regexp_split_to_array(text, pattern, flags), name)


def string_to_table(df: DataFrame, text: str, separator: str | None, name: str = "part", null_string: str | None = None) -> DataFrame:
    from brindle.functions import strings

    return _exploded(df, strings.string_to_array(text, separator, null_string), name)


def skeys(df: DataFrame, pairs: str, name: str = "key") -> DataFrame:
    return _exploded(df, F.map_keys(pairs), name)


def svals(df: DataFrame, pairs: str, name: str = "value") -> DataFrame:
    return _exploded(df, F.map_values(pairs), name)
