"""Mixing sources to target weights by hash-threshold histograms.

A row's place within its source is a hash of its id.  Tokens are summed by source and hash bucket; the running
sum over a source's 4096 buckets shows in which bucket its budget ends.  Only that boundary bucket is split into
4096 finer ones, and so on, until the threshold is exact.  Rows are then taken by comparing hash and threshold;
they are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD, lookup, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Hash bits a level of the histogram splits, and levels: 4 times 12 bits of a 48-bit hash.
LEVEL_BITS, LEVELS = 12, 4
#: Thresholds are broadcast up to this many sources (under 100 bytes each), joined by shuffle beyond.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id: Column) -> Column:
    """48 bits of the MD5 of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """For source, source_size: also weight and target.

    Sources in order of code points, null last, take the weights in turn and share the total by them.  A target
    stops at ``most`` times its source's size, and the excess goes to the others by weight: with sources in order
    of cap over weight, those before the first that isn't filled are at their caps.  One row a source, so that
    the windows over all of them stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double")
    full = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    s = s.withColumn("before", F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("ahead", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # the level at which the sources from here on would share what is left; the first that isn't filled sets it
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.col("before"), F.lit(0.0))) / F.col("ahead"))
    s = s.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _with_thresholds(rows: DataFrame, plan: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """rows with what plan has for their key.  Sources that hold much of the rows are broadcast in any case."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), "key")
    return lookup(rows, plan, "key", "rows", n_rows, "inner")


def mix(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """A row for each row of docs: the id, size, source_size, target, taken (words, repeats counted), copies.

    A source with target t and size s takes each row floor(t / s) times, and once more those rows whose hash is
    under a threshold: the largest at which they hold no more words than the rest of the target.  So taken words
    fall short of the target by less than the words that share one hash, and no row is taken over ``most`` times.
    The null source is a source; sources without words have target 0; rows with equal ids are taken alike; a null
    id is an id; empty texts have size 0 and take nothing.  The result depends on rows alone, so reruns agree.
    """
    rows, plan, n_sources, n_rows = thresholds(docs, id, text, source, weights, most)
    found = _with_thresholds(rows, plan, n_sources, n_rows).withColumn("copies", _copies(most))
    return found.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


def mixed_rows(docs: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """The mixture itself: the rows of docs, in its columns, each as often as it is taken; see mix()."""
    _, plan, n_sources, n_rows = thresholds(docs, id, text, source, weights, most)
    inner = docs.select(F.struct(*docs.columns).alias("row"), _key(F.col(source)).alias("key"), hash_of(F.col(id)).alias("h"))
    found = _with_thresholds(inner, plan, n_sources, n_rows).withColumn("copies", _copies(most)).filter("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _copies(most: int) -> Column:
    return (F.col("whole") + F.when((F.col("h") < F.col("threshold")) & (F.col("whole") < most), 1).otherwise(0)).cast("long")


def thresholds(docs: DataFrame, id: str, text: str, source: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, int, int]:
    """id, key (the source), size and hash of each row; of each key the whole copies of its rows and the hash threshold
    for one more; the numbers of sources and of rows."""
    rows = written(docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size"), hash_of(F.col(id)).alias("h")), "sizes")
    sums = written(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "sources")
    plan = targets(sums.select("source", "source_size"), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.select(_key(F.col("source")).alias("key"), "source_size", "target", F.least(whole, F.lit(most).cast("long")).alias("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("threshold", F.lit(0).cast("long"))
    plan = written(plan.join(sums.select(_key(F.col("source")).alias("key"), "rows"), "key"), "targets")
    totals = sums.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    rows = rows.select("id", _key(F.col("source")).alias("key"), "size", "h")
    for level in range(LEVELS):
        # a bucket of this level: the hash without its finer bits; threshold holds the bits found so far
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            inside = _with_thresholds(rows, plan.select("key", "threshold", "rows"), totals.sources, totals.rows)
            inside = inside.filter(F.shiftright("h", shift + LEVEL_BITS) == F.shiftright("threshold", shift + LEVEL_BITS))
        histogram = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        # a histogram has at most 4096 rows a source
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bucket"))
        both = histogram.withColumn("upto", upto).join(plan.select("key", "rest"), "key")
        # the boundary is the first bucket that doesn't fit whole; what comes before it is settled
        bound = both.groupBy("key").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))).alias("bucket"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("settled"),
            F.lit(True).alias("seen"),
        )
        # if no bucket overflows, all of the source is taken; a source that isn't refined any more keeps its threshold
        found = F.coalesce(F.shiftleft("bucket", shift), F.lit(1 << (LEVEL_BITS * LEVELS)).cast("long"))
        threshold = F.when(F.col("seen"), found).otherwise(F.col("threshold"))
        plan = plan.join(bound, "key", "left")
        plan = written(plan.select("key", "rows", "source_size", "target", "whole", (F.col("rest") - F.coalesce("settled", F.lit(0))).alias("rest"), threshold.alias("threshold")), "thresholds")
    return rows, plan, totals.sources, totals.rows
