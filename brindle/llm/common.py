"""What the corpus operators share: the shared folder, written tables, joins that stand skew."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII blanks, in Java's and in RE2's syntax.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session may lack it and gets a temporary folder; elsewhere that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='brindle-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Owns the tables that operators write while it is open, and removes them when it closes.

    Scopes nest, and each owns what is written in it alone.  Outside of any scope tables stay, as results may read
    them whenever they like.  What is to outlive a scope is written to a ``fresh_path`` before the scope closes.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._before = _OPEN.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _OPEN.reset(self._before)
        for path in self.paths:
            remove(self.spark, path)


_OPEN: ContextVar[Scratch | None] = ContextVar("open scratch", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here, and a lost executor
    costs a read rather than the work before.  The open Scratch owns the table."""
    path = fresh_path(df.sparkSession, name)
    owner = _OPEN.get()
    if owner:
        owner.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that come to Python at once, as texts may be long: Spark's default is ten times as many.
BATCH_ROWS = 1000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of Arrow batches in this session, unless the application was started with a bound of its own."""
    if not spark.sparkContext.getConf().contains(_BATCH_SETTING):
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


#: Bytes of text that are taken from an Arrow batch at once; a longer text comes alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes together; Spark bounds batches by rows only."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, upto = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Iterable[str], wish: str) -> str:
    """A column name that no column has yet; Spark compares names without case."""
    taken = {x.lower() for x in taken}
    while wish.lower() in taken:
        wish += "_"
    return wish


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Left (or inner) join on a key that is unique in right; ``count`` is right's column with the rows a key has in left.

    Keys with over 1/HOT_SHARE of the ``total`` rows are fewer than HOT_SHARE, whatever the size of the
    data, so their rows of right are broadcast and their rows of left stay where they are.  All others go
    through an ordinary join, in which no key can weigh much.  ``left`` is read twice: give a written table.
    """
    is_hot = F.col(count) * HOT_SHARE > F.lit(total)
    hot, rest = right.filter(is_hot), right.filter(~is_hot)
    keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(keys, key, "left_anti").join(rest, key, how))


#: Rows whose id has this remainder of its CRC-32 are held out from every fit.
HELD_OUT, FOLDS = 1, 3


def held_out(id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, rows: int) -> DataFrame:
    """sha (of the text), text and label (int, the largest of equal texts) of about ``rows`` labelled rows that aren't held out.

    Rows are chosen by a hash of the id, so that reruns choose the same, and the chosen labels are few enough to be
    broadcast.  Null labels and ids are left out.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL").filter(~held_out(F.col("id")))
    n = known.count()
    if n > rows:
        buckets = 1 << 30
        known = known.filter(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(buckets)) < int(buckets * rows / n))
    texts = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "id")
    return texts.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.any_value("text").alias("text"), F.max("label").alias("label"))
