"""Functions, aggregates, table functions and procedures that users define."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def create_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str, replace: bool = True) -> None:
    """CREATE FUNCTION in SQL: the body is an expression of the arguments, which the optimiser sees through.

    ``returns`` may be a table, as in "TABLE (a INT)"; the body is then a query.
    """
    spark.sql(f"CREATE {'OR REPLACE ' if replace else ''}TEMPORARY FUNCTION {name}({arguments}) RETURNS {returns} RETURN {body}")


def create_scalar(spark: SparkSession, name: str, f: Callable[..., pd.Series], returns: str, strict: bool = True) -> Callable[..., Column]:
    """A function over Arrow batches, also for SQL.  If strict, it doesn't see rows with a null argument."""

    def run(*args):
        if not strict:
            return f(*args)
        known = ~pd.concat([a.isna() for a in args], axis=1).any(axis=1)
        out = pd.Series([None] * len(args[0]), dtype=object)
        if known.any():
            out[known] = f(*(a[known] for a in args))
        return out

    udf = F.pandas_udf(run, T._parse_datatype_string(returns), F.PandasUDFType.SCALAR)
    spark.udf.register(name, udf)
    return udf


def create_aggregate(step: Callable[[Column, Column], Column], start: Column, final: Callable[[Column], Column] | None = None) -> Callable[..., Column]:
    """CREATE AGGREGATE (SFUNC, STYPE, INITCOND, FINALFUNC) of expressions.

    The state is folded over a group's values in the given order; the values of one group are gathered for that.
    For states that can be combined, create_combining_aggregate pre-aggregates.
    """

    def aggregate(x: Column | str, order: Column | str | None = None) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        if order is None:
            rows = F.transform(F.collect_list(F.struct(x.alias("x"))), lambda r: r["x"])
        else:
            rows = F.transform(F.array_sort(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), x.alias("x")))), lambda r: r["x"])
        return F.aggregate(rows, start, step, final) if final else F.aggregate(rows, start, step)

    return aggregate


def create_combining_aggregate(df: DataFrame, keys: list[str], x: str, step: Callable[[Any, Any], Any], combine: Callable[[Any, Any], Any], start: Any, returns: str, out: str, final: Callable[[Any], Any] | None = None) -> DataFrame:
    """An aggregate of Python functions with COMBINEFUNC: each batch folds its values into one state a group, and only
    states are shuffled and combined."""
    kind = T._parse_datatype_string(returns)
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("state", kind)])

    def fold(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, values in b.groupby(keys, dropna=False)[x] if keys else [((), b[x])]:
                state = start
                for v in values:
                    state = step(state, v)
                rows.append((*(key if isinstance(key, tuple) else (key,)), state))
            yield pd.DataFrame(rows, columns=[*keys, "state"])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        state = b.state.iloc[0]
        for s in b.state.iloc[1:]:
            state = combine(state, s)
        row = {k: [b[k].iloc[0]] for k in keys} | {out: [final(state) if final else state]}
        return pd.DataFrame(row)

    done = T.StructType([*(df.schema[k] for k in keys), T.StructField(out, kind)])
    return df.select(*keys, x).mapInPandas(fold, schema).groupBy(*keys).applyInPandas(merge, done)


def create_table_function(spark: SparkSession, name: str, rows: Callable[..., Iterable[tuple]], returns: str) -> None:
    """A set-returning function: a generator of rows for each call, for SQL as FROM name(...) or LATERAL name(...)."""

    class Made:
        def eval(self, *args: Any) -> Iterable[tuple]:
            yield from rows(*args)

    spark.udtf.register(name, F.udtf(Made, returnType=returns))


class Procedures:
    """CALL: named procedures over the session, in Python or as SQL scripts."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.known: dict[str, Callable[..., Any]] = {}

    def create(self, name: str, body: Callable[..., Any] | str) -> None:
        """A function of the session and the arguments, or a script whose :names are the arguments."""
        if isinstance(body, str):
            self.known[name] = lambda spark, **args: spark.sql(body, args=args)
        else:
            self.known[name] = body

    def call(self, name: str, *args: Any, **named: Any) -> Any:
        if name not in self.known:
            raise KeyError(f"procedure {name} does not exist")
        return self.known[name](self.spark, *args, **named)
