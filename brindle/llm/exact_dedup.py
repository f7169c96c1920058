"""Exact dedup against a persistent digest index.

The index is a table of one row for each distinct text, bucketed by its SHA-256 and sorted within the buckets.
A batch of new rows is digested, pre-aggregated by digest, sort-merge anti-joined with the index and what is new is
appended.  The index is never shuffled.  While a bucket is one file its side of the join needs no sort either; after
several batches the files of a bucket are sorted together as they are read, until compact() makes them one again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import free_name, fresh_path, lookup, partitions, remove, written

#: Copies of one row are told apart in arrays of so many.
RUN = 4096


def digest_of(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


class DigestIndex:
    """A digest index kept as a table of the session's catalog, with its files in ``path``.

    ``buckets`` is fixed when the table is made: choose it so that a bucket of the whole index, about 100
    bytes a distinct text, can be sorted by one task.
    """

    def __init__(self, spark: SparkSession, table: str, path: str, buckets: int) -> None:
        self.spark, self.table, self.path, self.buckets = spark, table, path, buckets
        if not spark.catalog.tableExists(table):
            self._append(spark.range(0).select(F.lit("").alias("text_sha256"), F.col("id").alias("keep_id")))

    def _append(self, rows: DataFrame) -> None:
        # dealt by the bucket key first, so that each bucket gets one file a batch
        dealt = rows.repartition(self.buckets, "text_sha256")
        dealt.write.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").mode("append").option("path", self.path).saveAsTable(self.table)

    def drop(self) -> None:
        """Remove the table and its files; decisions made so far don't read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)

    def compact(self) -> None:
        """Make each bucket one sorted file again, under a new path; the old files go."""
        old, self.path = self.path, fresh_path(self.spark, "digest_index")
        rows = written(self.entries(), "entries")
        self.spark.sql(f"DROP TABLE {self.table}")
        self._append(rows)
        remove(self.spark, old)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
        """Judge a batch and append what is new.  Returns decisions and groups.

        groups: a row for each distinct text of the batch: text_sha256, keep_id, group_size (rows of the batch),
        known (an earlier batch had it; then keep_id is the earlier one).  decisions: a row for each row of the
        batch: the id column, keep_id, group_size, kept, text_sha256.

        Of equal texts the row with the largest id stays, unless the text is known.  Null texts equal empty ones.
        Rows that repeat an id and a text count each, and one of them stays.  A null id is smaller than any other.
        An empty batch gives empty results.
        """
        ids = written(docs.select(F.col(id).alias("id"), digest_of(F.col(text)).alias("text_sha256")).groupBy("text_sha256", "id").agg(F.count(F.lit(1)).alias("n")), "digests")
        totals = ids.agg(F.coalesce(F.count(F.lit(1)), F.lit(0)).alias("rows")).first()
        batch = ids.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("n_ids"))
        # written, or else the optimiser joins before it aggregates and meets every copy
        batch = written(batch, "batch")
        fresh = batch.join(self.entries().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # written first: the anti-join reads the table that is appended to
        fresh = written(fresh, "fresh")
        earlier = batch.join(self.entries().withColumnRenamed("keep_id", "known_id").hint("merge"), "text_sha256")
        earlier = written(earlier.select("text_sha256", F.col("known_id").alias("keep_id"), "group_size", "n_ids", F.lit(True).alias("known")), "earlier")
        groups = fresh.withColumn("known", F.lit(False)).unionByName(earlier)
        self._append(fresh.select("text_sha256", F.col("keep_id").cast("long")))
        found = lookup(ids, groups, "text_sha256", "n_ids", totals["rows"])
        stays = F.col("id").eqNullSafe(F.col("keep_id")) & ~F.col("known")
        runs = found.withColumn("stays", stays).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
        copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, F.least(F.col("n"), F.col("run") * RUN + RUN))))
        decisions = copies.select(F.col("id").alias(id), "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256")
        return decisions, groups.drop("n_ids")


def exact_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Decisions for one table against an index that starts empty; see DigestIndex.add."""
    spark = docs.sparkSession
    path = fresh_path(spark, "digest_index")
    index = DigestIndex(spark, path.rpartition("/")[2].replace("-", "_"), path, buckets or partitions(spark))
    decisions = index.add(docs, id=id, text=text)[0]
    index.drop()
    return decisions


def kept_rows(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, whole, in their columns; of rows that repeat an id and a text, one."""
    own_sha, kept_id, kept_sha = free_name(docs.columns, "own_sha"), free_name(docs.columns, "kept_id"), free_name(docs.columns, "kept_sha")
    kept = written(exact_dedup(docs, id=id, text=text).filter("kept").select(F.col(id).alias(kept_id), F.col("text_sha256").alias(kept_sha)), "kept")
    own = docs.withColumn(own_sha, digest_of(F.col(text)))
    rows = own.join(kept, F.col(id).eqNullSafe(F.col(kept_id)) & (F.col(own_sha) == F.col(kept_sha)), "left_semi")
    twice = own.groupBy(F.col(id).alias(kept_id), own_sha).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # repeated rows are rare: only if there are any, rows are compared with one another
    return (rows if twice.isEmpty() else rows.dropDuplicates([id, own_sha])).drop(own_sha)
