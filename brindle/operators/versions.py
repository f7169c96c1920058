"""Version control of tables: commits, branches, tags, time travel, differences and three-way merges.

A commit is an entry of a log, and of each table the folder with its rows; unchanged tables share a folder.  Data only
moves through DataFrame joins.  The log, the refs and the table paths are small and kept as JSON lines in the store's
folder by Spark itself, so the store may lie wherever Spark can write.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Commit:
    id: str
    parents: list[str]
    message: str
    author: str
    time: float
    tables: dict[str, str]  # name: folder
    keys: dict[str, list[str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)


class Conflict(Exception):
    """A merge that can't be finished; ``conflicts`` holds a DataFrame for each table that has some."""

    def __init__(self, conflicts: dict[str, DataFrame]) -> None:
        super().__init__("merge has conflicts in " + ", ".join(sorted(conflicts)))
        self.conflicts = conflicts


class VersionStore:
    """Tables under version control in one folder.

    One writer at a time; readers see whole commits, as a ref moves only after everything it names is written.
    """

    def __init__(self, spark: SparkSession, path: str, author: str = "brindle") -> None:
        self.spark, self.path, self.author = spark, path.rstrip("/"), author
        state = self._read_state()
        self.commits: dict[str, Commit] = {c["id"]: Commit(**c) for c in state.get("commits", [])}
        self.branches: dict[str, str | None] = state.get("branches", {"main": None})
        self.tags: dict[str, str] = state.get("tags", {})
        self.current: str = state.get("current", "main")
        self.working: dict[str, str] = state.get("working", {})
        self.staged: list[str] = state.get("staged", [])
        self.keys: dict[str, list[str]] = state.get("keys", {})
        self.schemas: dict[str, str] = state.get("schemas", {})
        self.stashes: list[dict[str, str]] = state.get("stashes", [])
        self.ignored: list[str] = state.get("ignored", [])

    # state

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_state(self) -> dict:
        fs, p = self._fs(f"{self.path}/state")
        if not fs.exists(p):
            return {}
        newest = max(str(s.getPath()) for s in fs.listStatus(p))
        stream = fs.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(newest))
        try:
            reader = self.spark.sparkContext._jvm.java.io.BufferedReader(self.spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
            return json.loads(reader.readLine())
        finally:
            stream.close()

    def _save(self) -> None:
        state = {"commits": [asdict(c) for c in self.commits.values()]} | {k: getattr(self, k) for k in ("branches", "tags", "current", "working", "staged", "keys", "schemas", "stashes", "ignored")}
        fs, _ = self._fs(self.path)
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/{time.time_ns():020d}.json")
        stream = fs.create(target, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()

    # tables

    def _write(self, df: DataFrame) -> str:
        path = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def put(self, name: str, df: DataFrame, key: Iterable[str] | None = None) -> None:
        """Replace a table in the working set."""
        self.working[name] = self._write(df)
        self.schemas[name] = df.schema.json()
        if key is not None:
            self.keys[name] = list(key)
        self._save()

    def drop(self, name: str) -> None:
        self.working.pop(name, None)
        self._save()

    def _load(self, path: str, schema: str | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        reader = self.spark.read
        return (reader.schema(StructType.fromJson(json.loads(schema))) if schema else reader).parquet(path)

    def table(self, name: str, as_of: str | None = None) -> DataFrame:
        """The working table, or the table AS OF a ref: HEAD, branch, tag, commit, each with ^ and ~n."""
        if as_of is None:
            return self._load(self.working[name], self.schemas.get(name))
        commit = self.commits[self.resolve(as_of)]
        if name not in commit.tables:
            raise KeyError(f"table {name} doesn't exist at {as_of}")
        return self._load(commit.tables[name], commit.schemas.get(name))

    # refs

    @property
    def head(self) -> str | None:
        return self.branches.get(self.current)

    def resolve(self, ref: str) -> str:
        m = re.fullmatch(r"(.+?)((?:\^\d*|~\d*)*)", ref)
        name, steps = m[1], re.findall(r"(\^|~)(\d*)", m[2])
        if name.upper() == "HEAD":
            at = self.head
        elif name in self.branches:
            at = self.branches[name]
        elif name in self.tags:
            at = self.tags[name]
        else:
            found = [c for c in self.commits if c.startswith(name)]
            if len(found) != 1:
                raise KeyError(f"branch not found: {name}")
            at = found[0]
        for sign, n in steps:
            count = int(n) if n else 1
            for _ in range(count if sign == "~" else 1):
                parents = self.commits[at].parents
                want = 0 if sign == "~" else count - 1
                if want >= len(parents):
                    raise KeyError(f"invalid ancestor spec: {ref}")
                at = parents[want]
        return at

    def branch(self, name: str, start: str = "HEAD", delete: bool = False) -> None:
        if delete:
            if name == self.current:
                raise ValueError("cannot delete the current branch")
            del self.branches[name]
        else:
            if name in self.branches:
                raise ValueError(f"branch {name} exists")
            self.branches[name] = self.resolve(start) if self.commits else None
        self._save()

    def checkout(self, name: str, create: bool = False) -> None:
        """Switch; uncommitted changes stay only if nothing would be lost."""
        if create:
            self.branch(name)
        if name not in self.branches:
            raise KeyError(f"branch not found: {name}")
        if self.status_names() and self.branches[name] != self.head:
            raise ValueError("uncommitted changes")
        before = self.head
        self.current = name
        if self.branches[name] != before:
            self._reset_working(self.branches[name])
        self._save()

    def tag(self, name: str, ref: str = "HEAD", delete: bool = False) -> None:
        if delete:
            del self.tags[name]
        else:
            self.tags[name] = self.resolve(ref)
        self._save()

    # commits

    def add(self, *names: str) -> None:
        """Stage tables, by default all."""
        self.staged = sorted({*self.staged, *(names or self.status_names())})
        self._save()

    def commit(self, message: str, all: bool = True, parents: list[str] | None = None, allow_empty: bool = False) -> str:
        """Commit staged tables, or all."""
        base = self.commits[self.head].tables if self.head else {}
        changed = [n for n in self.status_names() if all or n in self.staged]
        if not changed and not allow_empty and parents is None:
            raise ValueError("nothing to commit")
        tables = dict(base)
        for n in changed:
            if n in self.working:
                tables[n] = self.working[n]
            else:
                tables.pop(n, None)
        parents = parents if parents is not None else [self.head] if self.head else []
        now = time.time()
        id_ = hashlib.sha1(json.dumps([parents, message, self.author, now, sorted(tables.items())]).encode()).hexdigest()
        self.commits[id_] = Commit(id_, parents, message, self.author, now, tables, {n: k for n, k in self.keys.items() if n in tables}, {n: s for n, s in self.schemas.items() if n in tables})
        self.branches[self.current] = id_
        self.staged = [n for n in self.staged if n not in changed]
        self._save()
        return id_

    def status_names(self) -> list[str]:
        base = self.commits[self.head].tables if self.head else {}
        return sorted(n for n in {*base, *self.working} if base.get(n) != self.working.get(n) and n not in self.ignored)

    def status(self) -> DataFrame:
        base = self.commits[self.head].tables if self.head else {}
        rows = [(n, n in self.staged, "new table" if n not in base else "deleted" if n not in self.working else "modified") for n in self.status_names()]
        return self.spark.createDataFrame(rows, "table_name string, staged boolean, status string")

    def ancestors(self, ref: str) -> dict[str, int]:
        """Commits that can be reached, with their distance."""
        seen, queue = {self.resolve(ref): 0}, [self.resolve(ref)]
        while queue:
            at = queue.pop(0)
            for p in self.commits[at].parents:
                if p not in seen:
                    seen[p] = seen[at] + 1
                    queue.append(p)
        return seen

    def log(self, ref: str = "HEAD") -> DataFrame:
        order = sorted(self.ancestors(ref).items(), key=lambda x: (x[1], -self.commits[x[0]].time)) if self.commits else []
        rows = [(c, self.commits[c].author, self.commits[c].time, self.commits[c].message, i) for i, (c, _) in enumerate(order)]
        out = self.spark.createDataFrame(rows, "commit_hash string, committer string, time double, message string, commit_order int")
        return out.withColumn("date", F.timestamp_micros((F.col("time") * 1_000_000).cast("long"))).drop("time")

    def commit_ancestors(self) -> DataFrame:
        rows = [(c.id, p, i) for c in self.commits.values() for i, p in enumerate(c.parents or [None])]
        return self.spark.createDataFrame(rows, "commit_hash string, parent_hash string, parent_index int")

    def branch_table(self) -> DataFrame:
        rows = [(n, c, self.commits[c].message if c else None) for n, c in sorted(self.branches.items())]
        return self.spark.createDataFrame(rows, "name string, hash string, latest_commit_message string")

    def tag_table(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.tags.items()), "tag_name string, tag_hash string")

    def merge_base(self, a: str, b: str) -> str | None:
        """A nearest common ancestor."""
        x, y = self.ancestors(a), self.ancestors(b)
        both = sorted((x[c] + y[c], -self.commits[c].time, c) for c in x if c in y)
        return both[0][2] if both else None

    # moving back

    def _reset_working(self, commit: str | None) -> None:
        c = self.commits[commit] if commit else None
        self.working = dict(c.tables) if c else {}
        self.keys |= c.keys if c else {}
        self.schemas |= c.schemas if c else {}
        self.staged = []

    def reset(self, ref: str = "HEAD", hard: bool = False) -> None:
        target = self.resolve(ref)
        self.branches[self.current] = target
        self.staged = []
        if hard:
            self._reset_working(target)
        self._save()

    def stash(self) -> None:
        """Put uncommitted changes aside."""
        self.stashes.append(dict(self.working))
        self._reset_working(self.head)
        self._save()

    def stash_pop(self) -> None:
        self.working = self.stashes.pop()
        self._save()

    def revert(self, ref: str) -> str:
        """A commit that undoes another: the merge of its parent with it as the ancestor."""
        c = self.resolve(ref)
        parent = self.commits[c].parents[0] if self.commits[c].parents else None
        return self._apply(c, parent, f'Revert "{self.commits[c].message}"')

    def cherry_pick(self, ref: str) -> str:
        """A commit with the changes of another one: its merge with its parent as the ancestor."""
        c = self.resolve(ref)
        parent = self.commits[c].parents[0] if self.commits[c].parents else None
        return self._apply(parent, c, self.commits[c].message)

    def _apply(self, ancestor: str | None, theirs: str | None, message: str) -> str:
        self._merge_into_working(ancestor, theirs)
        return self.commit(message)

    def rebase(self, upstream: str) -> str:
        """Put the current branch's own commits, one by one, on another ref."""
        base = self.merge_base("HEAD", upstream)
        own = [c for c in sorted(self.ancestors("HEAD"), key=lambda c: -self.ancestors("HEAD")[c]) if c not in self.ancestors(base)]
        self.reset(upstream, hard=True)
        for c in own:
            self.cherry_pick(c)
        return self.head

    def gc(self) -> int:
        """Delete folders that no commit, stash or working set names; how many."""
        used = {p for c in self.commits.values() for p in c.tables.values()} | {*self.working.values()} | {p for s in self.stashes for p in s.values()}
        fs, p = self._fs(f"{self.path}/data")
        gone = 0
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if not any(u.endswith("/" + s.getPath().getName()) for u in used):
                fs.delete(s.getPath(), True)
                gone += 1
        return gone

    # differences

    def diff(self, name: str, a: str, b: str | None = None) -> DataFrame:
        """Rows added, removed and modified from ref a to ref b, by default the working set."""
        key = self.keys.get(name)
        old = self._at(name, a)
        new = self._at(name, b)
        return diff_tables(old, new, key)

    def _at(self, name: str, ref: str | None) -> DataFrame | None:
        if ref is None:
            return self.table(name) if name in self.working else None
        commit = self.commits[self.resolve(ref)]
        return self._load(commit.tables[name], commit.schemas.get(name)) if name in commit.tables else None

    def _names(self, ref: str | None) -> dict[str, str]:
        return self.working if ref is None else self.commits[self.resolve(ref)].tables

    def diff_summary(self, a: str, b: str | None = None) -> DataFrame:
        """Tables that differ, how, and whether in data or schema."""
        rows = []
        old, new = self._names(a), self._names(b)
        for n in sorted({*old, *new}):
            if old.get(n) == new.get(n):
                continue
            kind = "added" if n not in old else "dropped" if n not in new else "modified"
            left, right = self._at(n, a), self._at(n, b)
            schema = kind != "modified" or left.schema != right.schema
            data = not (right if kind == "added" else left).isEmpty() if kind != "modified" else not diff_tables(left, right, self.keys.get(n)).isEmpty()
            rows.append((n if n in old else None, n if n in new else None, kind, data, schema))
        return self.spark.createDataFrame(rows, "from_table_name string, to_table_name string, diff_type string, data_change boolean, schema_change boolean")

    def diff_stat(self, name: str, a: str, b: str | None = None) -> DataFrame:
        d = self.diff(name, a, b)
        count = lambda k: F.count_if(F.col("diff_type") == k)
        return d.agg(count("added").alias("rows_added"), count("removed").alias("rows_deleted"), count("modified").alias("rows_modified"))

    def column_diff(self, a: str, b: str | None = None) -> DataFrame:
        """Columns added, dropped or changed in type."""
        rows = []
        old, new = self._names(a), self._names(b)
        for n in sorted({*old, *new}):
            left = dict(self._at(n, a).dtypes) if n in old else {}
            right = dict(self._at(n, b).dtypes) if n in new else {}
            rows += [(n, c, "added" if c not in left else "removed" if c not in right else "modified") for c in sorted({*left, *right}) if left.get(c) != right.get(c)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, diff_type string")

    def history(self, name: str) -> DataFrame:
        """All rows of a table at all commits of the current branch."""
        parts = [self._load(self.commits[c].tables[name], self.commits[c].schemas.get(name)).withColumn("commit_hash", F.lit(c)) for c in self.ancestors("HEAD") if name in self.commits[c].tables]
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)

    # merges

    def merge(self, ref: str, message: str | None = None) -> str:
        """Merge a ref into the current branch: fast-forward if possible, else cell by cell.

        With conflicts nothing is changed and Conflict is raised.
        """
        theirs = self.resolve(ref)
        base = self.merge_base("HEAD", theirs)
        if base == theirs:
            return self.head
        if self.status_names():
            raise ValueError("uncommitted changes")
        if base == self.head:
            self.branches[self.current] = theirs
            self._reset_working(theirs)
            self._save()
            return theirs
        before = self.head
        self._merge_into_working(base, theirs)
        return self.commit(message or f"Merge {ref} into {self.current}", parents=[before, theirs])

    def _merge_into_working(self, ancestor: str | None, theirs: str | None) -> None:
        anc = self.commits[ancestor].tables if ancestor else {}
        new = self.commits[theirs].tables if theirs else {}
        conflicts: dict[str, DataFrame] = {}
        result: dict[str, DataFrame | None] = {}
        for n in sorted({*anc, *new, *self.working}):
            a, t, o = anc.get(n), new.get(n), self.working.get(n)
            if t in (a, o):
                continue
            if o == a:
                result[n] = self._load(t, self.commits[theirs].schemas.get(n)) if t else None
                self.keys |= {n: self.commits[theirs].keys[n]} if t and n in self.commits[theirs].keys else {}
                continue
            key = self.keys.get(n)
            if not o or not t or not key:
                raise Conflict({n: self._load(o or t)})
            ours = self.table(n)
            their = self._load(t, self.commits[theirs].schemas.get(n))
            base = self._load(a, self.commits[ancestor].schemas.get(n)) if a else ours.limit(0)
            merged, bad = merge_tables(base, ours, their, key)
            if not bad.isEmpty():
                conflicts[n] = bad
            result[n] = merged
        if conflicts:
            raise Conflict(conflicts)
        for n, df in result.items():
            if df is None:
                self.working.pop(n, None)
            else:
                self.working[n] = self._write(df)
                self.schemas[n] = df.schema.json()
        self._save()

    def constraint_violations(self, foreign_keys: Iterable[tuple[str, dict[str, str], str]]) -> DataFrame:
        """Rows of the working set that break a primary or one of the given foreign keys (child, keys, parent)."""
        from brindle.operators.dml import foreign_key_violations, primary_key_violations

        parts = [primary_key_violations(self.table(n), k).select(F.lit("unique index").alias("violation_type"), F.lit(n).alias("table"), F.to_json(F.struct(*k)).alias("row")) for n, k in self.keys.items() if n in self.working]
        parts += [foreign_key_violations(self.table(c), self.table(p), k).select(F.lit("foreign key").alias("violation_type"), F.lit(c).alias("table"), F.to_json(F.struct(*k)).alias("row")) for c, k, p in foreign_keys]
        return reduce(DataFrame.unionByName, parts)


def _all_columns(*tables: DataFrame) -> list[str]:
    return list(dict.fromkeys(c for t in tables for c in t.columns))


def _wide(df: DataFrame, columns: list[str], like: list[DataFrame]) -> DataFrame:
    kinds = {c: t for d in reversed(like) for c, t in d.dtypes}
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))


def diff_tables(old: DataFrame | None, new: DataFrame | None, key: list[str] | None) -> DataFrame:
    """from_* and to_* columns and diff_type (added, removed, modified) of rows that differ.

    With a key, one full outer join on it; unchanged rows are dropped by comparing the other columns as one struct.
    Without, rows are counted, and one that is there more often on one side counts as added or removed.
    """
    if old is None:
        old = new.limit(0)
    if new is None:
        new = old.limit(0)
    columns = _all_columns(old, new)
    a, b = (_wide(t, columns, [new, old]) for t in (old, new))
    if not key:
        counted = a.withColumn("__n", F.lit(-1)).unionByName(b.withColumn("__n", F.lit(1))).groupBy(*columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
        rows = counted.withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))))
        side = lambda c, add: F.when((F.col("__n") > 0) == F.lit(add), F.col(c))
        return rows.select(*(side(c, False).alias(f"from_{c}") for c in columns), *(side(c, True).alias(f"to_{c}") for c in columns), F.when(F.col("__n") > 0, "added").otherwise("removed").alias("diff_type"))
    left = a.select(*(F.col(c).alias(f"from_{c}") for c in columns), F.lit(True).alias("__a"))
    right = b.select(*(F.col(c).alias(f"to_{c}") for c in columns), F.lit(True).alias("__b"))
    both = left.join(right, reduce(lambda x, y: x & y, (F.col(f"from_{k}") == F.col(f"to_{k}") for k in key)), "full")
    rest = [c for c in columns if c not in key]
    same = F.struct(*(F.col(f"from_{c}") for c in rest)).eqNullSafe(F.struct(*(F.col(f"to_{c}").alias(f"from_{c}") for c in rest))) if rest else F.lit(True)
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~same, "modified")
    return both.withColumn("diff_type", kind).filter("diff_type IS NOT NULL").drop("__a", "__b")


def merge_tables(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Three-way merge of tables with a key: the merged rows without those in conflict, and the conflicts.

    A cell that one side changed takes that side's value, one that both changed alike takes it too, and one that both
    changed differently is a conflict, as is a row that one side deleted and the other changed.  Columns that a side
    added are kept.  Conflicts have base_, our_ and their_ columns and the type of either change.
    """
    columns = _all_columns(ours, theirs, base)
    gone = [c for c in base.columns if (c not in ours.columns) or (c not in theirs.columns)]
    columns = [c for c in columns if c not in gone]
    tables = [ours, theirs, base]
    # a column that a side lacks has there what the ancestor has, that is, nothing
    o, t, b = (_wide(d, columns, tables).withColumn("__in", F.lit(True)) for d in (ours, theirs, base))
    named = lambda d, p: d.select(*(F.col(c).alias(f"{p}_{c}") for c in (*columns, "__in")))
    on = lambda p, q: reduce(lambda x, y: x & y, (F.coalesce(F.col(f"{p}_{k}"), F.col(f"base_{k}")) == F.col(f"{q}_{k}") if q == "their" else F.col(f"{p}_{k}") == F.col(f"{q}_{k}") for k in key))
    rows = named(b, "base").join(named(o, "our"), on("base", "our"), "full")
    rows = rows.join(named(t, "their"), on("our", "their"), "full")
    inb, ino, int_ = (F.col(f"{p}___in").isNotNull() for p in ("base", "our", "their"))
    rest = [c for c in columns if c not in key]
    both = lambda x, y: reduce(lambda u, v: u & v, (F.col(f"{x}_{c}").eqNullSafe(F.col(f"{y}_{c}")) for c in rest), F.lit(True))
    same_ob, same_tb, same_ot = both("our", "base"), both("their", "base"), both("our", "their")

    def cell(c: str) -> Column:
        x, y, z = (F.col(f"{p}_{c}") for p in ("our", "their", "base"))
        return F.when(x.eqNullSafe(y), x).when(inb & x.eqNullSafe(z), y).when(inb & y.eqNullSafe(z), x).otherwise(x)

    def clash(c: str) -> Column:
        x, y, z = (F.col(f"{p}_{c}") for p in ("our", "their", "base"))
        return ~x.eqNullSafe(y) & (~inb | ~x.eqNullSafe(z) & ~y.eqNullSafe(z))

    any_clash = reduce(lambda u, v: u | v, (clash(c) for c in rest), F.lit(False))
    conflict = F.when(ino & int_, any_clash).when(inb & ino & ~int_, ~same_ob).when(inb & int_ & ~ino, ~same_tb).otherwise(F.lit(False))
    stays = F.when(ino & int_, F.lit(True)).when(ino, ~inb).when(int_, ~inb).otherwise(F.lit(False))
    marked = rows.withColumn("__conflict", conflict)
    value = lambda c: F.when(ino & int_, cell(c)).when(ino, F.col(f"our_{c}")).otherwise(F.col(f"their_{c}"))
    merged = marked.filter(~F.col("__conflict") & stays).select(*(value(c).alias(c) for c in columns))
    change = lambda here, same: F.when(~inb, "added").when(~here, "removed").when(same, "unmodified").otherwise("modified")
    conflicts = marked.filter("__conflict").select(*(F.col(f"{p}_{c}") for p in ("base", "our", "their") for c in columns), change(ino, same_ob).alias("our_diff_type"), change(int_, same_tb).alias("their_diff_type"))
    return merged, conflicts


def resolve_conflicts(merged: DataFrame, conflicts: DataFrame, take: str) -> DataFrame:
    """Finish a merge by taking "ours" or "theirs" for every row in conflict."""
    side, kind = ("our", "our_diff_type") if take == "ours" else ("their", "their_diff_type")
    rows = conflicts.filter(F.col(kind) != "removed").select(*(F.col(f"{side}_{c}").alias(c) for c in merged.columns))
    return merged.unionByName(rows)
