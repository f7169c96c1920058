"""Changes of tables as rewrites of DataFrames, and constraints as queries for what violates them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.relational import free_name
from brindle.session import scratch


def _on(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys))


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT: missing columns are null."""
    return target.unionByName(rows, allowMissingColumns=True)


def insert_on_conflict_nothing(target: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING: of new rows with one key the first in the order of all columns is added."""
    w = Window.partitionBy(*keys).orderBy(*(c for c in rows.columns if c not in keys) or keys)
    first = rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return target.unionByName(first.join(target, list(keys), "left_anti").select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: Sequence[str], changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE SET changes [WHERE].

    In ``changes`` and ``where`` the stored row is ``t`` and the new one ``excluded``; by default every other column
    takes the new value.  Keys must be unique in ``rows``, as a row can't be changed twice.
    """
    others = [c for c in target.columns if c not in keys]
    changes = changes if changes is not None else {c: F.col(f"excluded.{c}") for c in others if c in rows.columns}
    both = target.alias("t").withColumn("__old", F.lit(True)).alias("t").join(rows.withColumn("__new", F.lit(True)).alias("excluded"), _on(keys, "t", "excluded"), "full")
    old, new = F.col("t.__old").isNotNull(), F.col("excluded.__new").isNotNull()
    hit = old & new & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    out = []
    for c in target.columns:
        fresh = F.col(f"excluded.{c}") if c in rows.columns else F.lit(None)
        kept = F.col(f"t.{c}")
        changed = changes.get(c, kept)
        out.append(F.when(~old, fresh).when(hit, changed).otherwise(kept).cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def update(target: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE: all new values see the old row."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return target.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in target.columns))


def _first_of(rows: DataFrame, keys: Sequence[str], name: str) -> Column:
    """A row's place among those of its keys, in the order of all columns, as ``name``."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*(c for c in rows.columns if c not in keys) or keys)).alias(name)


def update_from(target: DataFrame, source: DataFrame, keys: Sequence[str], changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... FROM an equi-join; in ``changes`` and ``where`` the row is ``t``, the other ``s``.

    A row is changed once, by the first of the source rows that meet it, in the order of the source's columns.
    """
    if where is None:
        ranked = source.select("*", _first_of(source, keys, "__n")).filter("__n = 1").drop("__n")
        both = target.alias("t").join(ranked.withColumn("__hit", F.lit(True)).alias("s"), _on(keys, "t", "s"), "left")
        hit = F.coalesce(F.col("s.__hit"), F.lit(False))
    else:
        own = target.withColumn("__row", F.monotonically_increasing_id())
        joined = own.alias("t").join(source.withColumn("__hit", F.lit(True)).alias("s"), _on(keys, "t", "s"), "left")
        met = joined.withColumn("__met", F.coalesce(F.col("s.__hit") & where, F.lit(False)))
        # by the keys first, as the join has dealt the rows
        w = Window.partitionBy(*(F.col(f"t.{k}") for k in keys), F.col("t.__row")).orderBy(F.col("__met").desc(), *(F.col(f"s.{c}") for c in source.columns))
        both = met.withColumn("__n", F.row_number().over(w)).filter("__n = 1")
        hit = F.col("__met")
    return both.select(*(F.when(hit, changes[c]).otherwise(F.col(f"t.{c}")).cast(target.schema[c].dataType).alias(c) if c in changes else F.col(f"t.{c}").alias(c) for c in target.columns))


def delete(target: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows stay unless the condition is true."""
    return target.filter(~F.coalesce(where, F.lit(False)))


def truncate(target: DataFrame) -> DataFrame:
    """TRUNCATE: no rows, the same columns."""
    return target.limit(0)


def delete_using(target: DataFrame, source: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    on = _on(keys, "t", "s")
    return target.alias("t").join(source.alias("s"), on & where if where is not None else on, "left_anti")


def merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *, matched: Sequence[tuple[Column | None, dict[str, Column] | str]] = (), not_matched: Sequence[tuple[Column | None, dict[str, Column]]] = (), not_matched_by_source: Sequence[tuple[Column | None, dict[str, Column] | str]] = ()) -> DataFrame:
    """MERGE: for each kind the first clause whose condition holds acts; "delete" and "nothing" are actions too.

    One full outer join and a choice for each column; rows that a clause deletes are filtered out.  A clause that
    changes or deletes a row which several source rows match raises, as no row may be affected twice.
    """
    numbered = source.select("*", F.lit(True).alias("__s"), _first_of(source, keys, "__n"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("__of"))
    both = target.withColumn("__t", F.lit(True)).alias("t").join(numbered.alias("s"), _on(keys, "t", "s"), "full")
    kinds = ((F.col("t.__t").isNotNull() & F.col("s.__s").isNotNull(), matched), (F.col("t.__t").isNull(), not_matched), (F.col("s.__s").isNull(), not_matched_by_source))
    action = F.lit(None).cast("int")
    clauses: list[dict[str, Column] | str] = []
    chosen = []
    for kind, parts in kinds:
        for condition, what in parts:
            chosen.append((kind & (F.coalesce(condition, F.lit(False)) if condition is not None else F.lit(True)), len(clauses)))
            clauses.append(what)
    for condition, number in reversed(chosen):
        action = F.when(condition, F.lit(number)).otherwise(action)
    both = both.withColumn("__action", action)
    gone = [i for i, c in enumerate(clauses) if isinstance(c, str) and c == "delete"]
    added = [i for i, (_, parts) in enumerate(kinds) for _ in parts if i == 1]
    insert_numbers = [n for n, c in enumerate(clauses) if not isinstance(c, str) and len(matched) <= n < len(matched) + len(added)]
    stays = F.col("t.__t").isNotNull() | F.coalesce(F.col("__action").isin(*insert_numbers), F.lit(False)) if insert_numbers else F.col("t.__t").isNotNull()
    if gone:
        stays = stays & ~F.coalesce(F.col("__action").isin(*gone), F.lit(False))
    acts = [n for n, c in enumerate(clauses) if n < len(matched) and c != "nothing"]
    if matched:
        # of several source rows that do nothing to a row, one stands for it
        stays = stays & (F.col("t.__t").isNull() | F.col("s.__s").isNull() | (F.col("s.__n") == 1))
    if acts:
        twice = F.col("t.__t").isNotNull() & (F.col("s.__of") > 1) & F.coalesce(F.col("__action").isin(*acts), F.lit(False))
        stays = F.when(twice, F.raise_error(F.lit("MERGE command cannot affect row a second time")).cast("boolean")).otherwise(stays)
    out = []
    for c in target.columns:
        value = F.col(f"t.{c}")
        for n, what in enumerate(clauses):
            if isinstance(what, dict):
                if c in what:
                    value = F.when(F.col("__action") == n, what[c]).otherwise(value)
                elif n in insert_numbers:
                    value = F.when(F.col("__action") == n, F.lit(None)).otherwise(value)
        out.append(value.cast(target.schema[c].dataType).alias(c))
    return both.filter(stays).select(*out)


# RETURNING: the rows that a statement has touched, whether their values differ or not


def insert_returning(target: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT ... RETURNING *: the new rows, as they are stored."""
    return target.limit(0).unionByName(rows, allowMissingColumns=True).select(*(F.col(c).cast(target.schema[c].dataType).alias(c) for c in target.columns))


def update_returning(target: DataFrame, changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... RETURNING *: rows that the condition holds for, with their new values."""
    hit = target.filter(where) if where is not None else target
    return update(hit, changes)


def delete_returning(target: DataFrame, where: Column | None = None) -> DataFrame:
    """DELETE ... RETURNING *: the rows that go."""
    return target.filter(where) if where is not None else target


def upsert_returning(target: DataFrame, rows: DataFrame, keys: Sequence[str], changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE ... RETURNING *: rows added or updated, not those that ``where`` spares."""
    touched = target.join(rows.select(*keys), list(keys), "left_semi")
    if where is not None:
        hit = touched.alias("t").join(rows.alias("excluded"), _on(keys, "t", "excluded")).filter(where).select(*(F.col(f"t.{k}").alias(k) for k in keys))
        spared = touched.join(hit, list(keys), "left_anti").select(*keys)
        rows = rows.join(spared, list(keys), "left_anti")
    return upsert(touched, rows, keys, changes, where).join(rows.select(*keys), list(keys), "left_semi").select(*target.columns)


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that a row leaves out get their default."""
    return rows.withColumns({c: d for c, d in defaults.items() if c not in rows.columns})


def with_generated(rows: DataFrame, generated: dict[str, Column]) -> DataFrame:
    """Generated columns, made anew from the others."""
    return rows.withColumns(generated)


def with_identity(rows: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """Numbers of a sequence, without gaps, in the order of the partitions and the rows in them.

    Each task numbers its own rows and a table of them is written, so that a stage that runs again can't number them
    anew; a row for each partition then says how many come before it.
    """
    part, place, n = (free_name(rows.columns, x) for x in ("part", "place", "n"))
    marked = rows.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    path = scratch(rows.sparkSession, "identity")
    marked.write.parquet(path)
    stored = rows.sparkSession.read.schema(marked.schema).parquet(path)
    sizes = stored.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    before = sizes.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(n))
    # a row for each partition, fewer than a million
    return stored.join(F.broadcast(before), part).select(*(F.col(c) for c in rows.columns), (F.lit(start) + (F.col(n) + F.col(place)) * step).alias(name))


class Sequence_:
    """nextval, currval, lastval and setval: a counter on the driver that hands out ranges."""

    def __init__(self, start: int = 1, step: int = 1, maximum: int = (1 << 63) - 1, cycle: bool = False) -> None:
        self.start, self.step, self.maximum, self.cycle = start, step, maximum, cycle
        self.next, self.last = start, None

    def nextval(self, n: int = 1) -> int:
        """The first of n numbers taken."""
        if self.next + (n - 1) * self.step > self.maximum:
            if not self.cycle:
                raise ValueError("reached maximum value of sequence")
            self.next = self.start
        self.last = self.next + (n - 1) * self.step
        self.next += n * self.step
        return self.last - (n - 1) * self.step

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval is not yet defined")
        return self.last

    lastval = currval

    def setval(self, value: int, called: bool = True) -> int:
        self.last = value
        self.next = value + self.step if called else value
        return value


# Constraints: each gives the rows or keys that violate it


def unique_violations(df: DataFrame, keys: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    rows = df.dropna(subset=list(keys)) if nulls_distinct else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | missing)


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """A check is violated only where it is false."""
    return df.filter(~F.coalesce(check, F.lit(True)))


def foreign_key_violations(child: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows of child whose keys are all known and not in parent."""
    named = parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    return child.dropna(subset=list(keys)).join(named, list(keys), "left_anti")


def cascade_delete(child: DataFrame, gone: DataFrame, keys: dict[str, str], action: str = "cascade") -> DataFrame:
    """What is left of child when rows of its parent go: cascade, set null or restrict."""
    named = gone.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    if action == "cascade":
        return child.join(named, list(keys), "left_anti")
    if action == "set null":
        hit = child.join(named.withColumn("__gone", F.lit(True)), list(keys), "left")
        return hit.select(*(F.when(F.col("__gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in keys else F.col(c) for c in child.columns))
    if not child.join(named, list(keys), "left_semi").isEmpty():
        raise ValueError("rows are still referenced")
    return child


def overlap_violations(df: DataFrame, keys: Sequence[str], start: str, end: str, identity: Sequence[str]) -> DataFrame:
    """WITHOUT OVERLAPS: rows whose period begins before one of the same key that began earlier has ended.

    Of periods that begin together the one with the smaller ``identity`` counts as earlier; rows that agree in it, too,
    don't count against each other, and null keys equal nothing.  A running maximum over the periods of a key finds
    them without pairing rows.
    """
    earlier = Window.partitionBy(*keys).orderBy(start, *identity).rowsBetween(Window.unboundedPreceding, -1)
    # of rows that agree the first one's maximum; in a struct, as it may be null
    alike = Window.partitionBy(*keys, start, *identity)
    known = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys), F.lit(True))
    found = df.filter(known).withColumn("__until", F.struct(F.max(end).over(earlier).alias("v"))).withColumn("__until", F.min("__until").over(alike))
    return found.filter(F.col(start) < F.col("__until.v")).drop("__until")


def on_each_row(rows: DataFrame, *triggers: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """BEFORE ... FOR EACH ROW triggers as functions of the rows, in the order of their names."""
    for t in sorted(triggers, key=lambda f: f.__name__):
        rows = t(rows)
    return rows


def with_policy(df: DataFrame, *permissive: Column, restrictive: Sequence[Column] = ()) -> DataFrame:
    """Row security: rows that any permissive and every restrictive policy admits; none if there is no permissive one."""
    if not permissive:
        return df.limit(0)
    seen = reduce(lambda a, b: a | b, permissive)
    return df.filter(reduce(lambda a, b: a & b, restrictive, seen))
