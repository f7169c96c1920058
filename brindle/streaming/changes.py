"""Change streams: capturing, publishing and applying row changes.

A change is a row with op (insert, update, delete, truncate), lsn (its place in the stream) and the table's columns.
Applying is a merge of each micro-batch into a versioned table; the last lsn applied is kept with the table, so a
batch that is seen again changes nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators.versions import VersionStore, diff_tables


def capture(old: DataFrame | None, new: DataFrame | None, key: Sequence[str], lsn: int) -> DataFrame:
    """Changes that lead from one state of a table to another, all with one lsn."""
    d = diff_tables(old, new, list(key))
    columns = (new if new is not None else old).columns
    op = F.when(F.col("diff_type") == "added", "insert").when(F.col("diff_type") == "removed", "delete").otherwise("update")
    value = lambda c: F.when(op == "delete", F.col(f"from_{c}")).otherwise(F.col(f"to_{c}"))
    return d.select(op.alias("op"), F.lit(lsn).cast("long").alias("lsn"), *(value(c).alias(c) for c in columns))


def latest(changes: DataFrame, key: Sequence[str], order: Sequence[str] = ("lsn",)) -> DataFrame:
    """Of the changes of one key the last; what comes before a truncate is dropped."""
    cut = changes.filter("op = 'truncate'").agg(F.max("lsn").alias("cut"))
    rows = changes.crossJoin(F.broadcast(cut)).filter("op <> 'truncate' AND (cut IS NULL OR lsn > cut)").drop("cut")
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def apply(target: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after the changes: one full outer join."""
    last = latest(changes, key)
    emptied = changes.filter("op = 'truncate'").limit(1)
    base = target if emptied.isEmpty() else target.limit(0)
    columns = target.columns
    new = last.select(F.col("op").alias("__op"), *(F.col(c).alias(f"__{c}") for c in columns))
    on = [F.col(c) == F.col(f"__{c}") for c in key]
    both = base.join(new, on, "full")
    hit = F.col("__op").isNotNull()
    return both.filter(~F.coalesce(F.col("__op") == "delete", F.lit(False))).select(*(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in columns))


class Subscription:
    """Applies a stream of changes to a table of a version store, a commit for each micro-batch."""

    def __init__(self, store: VersionStore, table: str, key: Sequence[str]) -> None:
        self.store, self.table, self.key = store, table, list(key)

    def position(self) -> int:
        """The last lsn applied, from the commit messages."""
        for c in sorted(self.store.ancestors("HEAD").items(), key=lambda x: x[1]) if self.store.head else []:
            message = self.store.commits[c[0]].message
            if message.startswith(f"apply {self.table} "):
                return int(message.rsplit(" ", 1)[1])
        return -1

    def apply_batch(self, batch: DataFrame, batch_id: int = 0) -> None:
        fresh = batch.filter(F.col("lsn") > self.position())
        top = fresh.agg(F.max("lsn").alias("m")).first().m
        if top is None:
            return
        self.store.put(self.table, apply(self.store.table(self.table), fresh, self.key), self.key)
        self.store.commit(f"apply {self.table} {top}", allow_empty=True)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        writer = stream.writeStream.foreachBatch(self.apply_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


class _Folder:
    """Small files in a shared folder, each written whole under another name and then renamed."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.path = path.rstrip("/")
        self.fs = self.hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}")

    def write(self, name: str, text: str) -> None:
        fresh = self.at(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(name)):
            self.fs.delete(self.at(name), False)
        self.fs.rename(fresh, self.at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        raw = bytes(stream.readAllBytes())
        stream.close()
        return raw.decode()

    def names(self, folder: str) -> list[str]:
        if not self.fs.exists(self.at(folder)):
            return []
        return sorted(n for s in self.fs.listStatus(self.at(folder)) if not (n := s.getPath().getName()).startswith("."))


class Slots:
    """Outbound replication slots: each remembers how far its reader has confirmed.

    With a folder, which must be shared and durable, slots outlive the process and any driver can go on with them.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None) -> None:
        self.folder = _Folder(spark, path) if path else None
        self.confirmed: dict[str, int] = {}
        if self.folder:
            self.confirmed = {n: int(self.folder.read(f"slots/{n}")) for n in self.folder.names("slots")}
        self.listeners: dict[str, list[Callable[[str], None]]] = {}

    def _save(self, name: str) -> None:
        if self.folder:
            self.folder.write(f"slots/{name}", str(self.confirmed[name]))

    def create(self, name: str, start: int = 0) -> None:
        if name in self.confirmed:
            raise ValueError(f'replication slot "{name}" already exists')
        self.confirmed[name] = start
        self._save(name)

    def drop(self, name: str) -> None:
        del self.confirmed[name]
        if self.folder:
            self.folder.fs.delete(self.folder.at(f"slots/{name}"), False)

    def read(self, name: str, log: DataFrame) -> DataFrame:
        """What the slot's reader hasn't confirmed, in order of lsn."""
        return log.filter(F.col("lsn") > self.confirmed[name]).orderBy("lsn")

    def confirm(self, name: str, lsn: int) -> None:
        self.confirmed[name] = max(self.confirmed[name], lsn)
        self._save(name)

    def listen(self, channel: str, f: Callable[[str], None]) -> None:
        self.listeners.setdefault(channel, []).append(f)

    def notify(self, channel: str, payload: str = "") -> int:
        for f in self.listeners.get(channel, []):
            f(payload)
        return len(self.listeners.get(channel, []))


class Channels:
    """LISTEN and NOTIFY between processes: a notification is a file, a listener reads those it hasn't seen.

    A channel's folder can also be read as a stream of texts.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = _Folder(spark, path)

    def notify(self, channel: str, payload: str = "") -> None:
        self.folder.write(f"channels/{channel}/{time.time_ns():020d}-{uuid.uuid4().hex}", payload)

    def listen(self, channel: str) -> Listener:
        """Notifications from now on."""
        return Listener(self, channel, set(self.folder.names(f"channels/{channel}")))


@dataclass
class Listener:
    channels: Channels
    channel: str
    seen: set[str]

    def poll(self) -> list[str]:
        """Payloads that have come since the last call, in order; equal ones as often as they were sent."""
        new = [n for n in self.channels.folder.names(f"channels/{self.channel}") if n not in self.seen]
        self.seen |= set(new)
        return [self.channels.folder.read(f"channels/{self.channel}/{n}") for n in new]
