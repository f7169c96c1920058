"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most ``threshold`` bits differ in at most threshold // parts bits on one of the
``parts`` pieces they are cut into.  For each piece a covering code, made of Hamming codes and free bits, gives the
anchors: every value lies within the covering radius of its home anchor.  Each fingerprint is replicated to all
anchors within the covering radius plus the piece's share of the threshold, so it meets there every fingerprint at
home that it may be linked with.  Comparing per anchor finds all links; of an anchor's links a spanning forest is
passed on, and stars are contracted until each component has one root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import free_name, lookup, partitions, slices, small_batches, written

SHINGLE = 4
THRESHOLD = 4
SEED = 42
#: Up to so many distinct fingerprints three pieces with 2**17 anchors or more each are enough; beyond, two with 2**24.
THREE_PIECES = 1 << 26
#: An anchor with more fingerprints at home is dealt into slices of so many, each met by all that come to the anchor.
SLICE = 4096
#: Up to so many crowded anchors are broadcast whole.
BROADCAST_ANCHORS = 1_000_000
#: Pairs compared at once.
PAIRS = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: For each byte, its eight bits in the eight bytes of a word, most significant first.
_SPREAD = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, :, None].repeat(8, 2) * np.array([0, 0, 0, 0, 0, 0, 0, 1], np.uint8), axis=2).reshape(256, 8).copy().view(np.uint64).ravel()


def fingerprints_of(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints (uint64) of texts: a bit is set if over half of the shingles' hashes have it."""
    hash_ = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        words = (raw or b"").translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(hash_(joined, SEED))
            counts[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-1]][: len(words) - shingle + 1].tolist()
        hashes += [hash_(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    first = np.cumsum(n) - n
    # 255 hashes at most are summed in a byte, then the sums in integers
    cuts = np.unique(np.concatenate([first, np.arange(0, len(hashes), 255)]))
    cuts = np.unique(np.concatenate([cuts, *(np.arange(a, a + k, 255) for a, k in zip(first.tolist(), n.tolist(), strict=True) if k > 255)]))
    bytes_ = np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    sums = np.add.reduceat(_SPREAD[bytes_], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
    total = np.add.reduceat(sums.astype(np.int64), np.searchsorted(cuts, first), axis=0)
    out[some] = np.packbits(total * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprinted(docs: DataFrame, *, text: str = "text", shingle: int = SHINGLE, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, by default all) with the fingerprint as a signed long ``out``; a column named so is
    replaced.  Null and empty texts have fingerprint 0."""
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    kept = [f"k{i}" for i in range(len(keep))]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                found = fingerprints_of(part.column("text").to_pylist(), shingle)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(found.view(np.int64))], names=[*keep, out])

    # kept columns go under numbers, so that none can clash with the text
    own = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(text).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.LongType())]))


@dataclass(frozen=True)
class Piece:
    """Bits [low, low + width) of a fingerprint with their covering code: 15-bit Hamming codes, then free bits."""

    number: int
    low: int
    width: int

    @property
    def codes(self) -> int:
        """Hamming codes in the piece; each covers its 15 bits with radius 1, so this is the covering radius."""
        return self.width // 15

    def value(self, fp: np.ndarray) -> np.ndarray:
        return (fp >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)

    def syndrome(self, value: np.ndarray) -> np.ndarray:
        """Of each code four bits: the sum of the positions (1 to 15) of the bits that are set; 0 at anchors."""
        out = np.zeros(len(value), np.int64)
        for c in range(self.codes):
            for b in range(4):
                check = sum(1 << (15 * c + p - 1) for p in range(1, 16) if p >> b & 1)
                out |= (np.bitwise_count(value & np.uint64(check)).astype(np.int64) & 1) << (4 * c + b)
        return out

    def steps(self, reach: int) -> list[np.ndarray]:
        """For each syndrome, the changes of up to ``reach`` bits that lead to an anchor, the one home first."""
        masks = np.array([sum(1 << b for b in bits) for n in range(reach + 1) for bits in combinations(range(self.width), n)], np.uint64)
        to = self.syndrome(masks)
        return [masks[to == s] for s in range(1 << (4 * self.codes))]


def pieces(parts: int) -> list[Piece]:
    edges = [64 * i // parts for i in range(parts + 1)]
    return [Piece(i, a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _replicate(threshold: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(p, p.steps(p.codes + threshold // parts)) for p in pieces(parts)]
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for piece, steps in tables:
                value = piece.value(fp)
                syndrome = piece.syndrome(value)
                for s, masks in enumerate(steps):
                    at = np.flatnonzero(syndrome == s)
                    if len(at):
                        anchor = (value[at][:, None] ^ masks[None, :]).ravel().astype(np.int64) + (piece.number << 40)
                        home = np.tile(np.arange(len(masks)) == 0, len(at))
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(np.repeat(fp[at], len(masks)).view(np.int64)), pa.array(home)], names=["anchor", "fp", "home"])

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 and links a-b, the least node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links(fp: np.ndarray, home: np.ndarray, start: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each group: rows [start, start + size), in which the homes come first."""
    homes = np.add.reduceat(home.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    left = np.repeat(start, homes) + np.arange(homes.sum()) - np.repeat(np.cumsum(homes) - homes, homes)
    first, n = np.repeat(start, homes), np.repeat(size, homes)
    label = np.arange(len(fp))
    at = 0
    ends = np.cumsum(n)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        k = n[at:to]
        x = np.repeat(left[at:to], k)
        y = np.repeat(first[at:to], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        near = np.bitwise_count(fp[x] ^ fp[y]) <= threshold
        near &= label[x] != label[y]
        if near.any():
            label = _forest(len(fp), np.concatenate([x[near], np.arange(len(fp))]), np.concatenate([y[near], label]))
        at = to
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(fp: np.ndarray, home: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = _links(fp, home, start, size, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: tuple[np.ndarray, ...] | None = None  # the rows of the last group so far
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column("anchor").to_numpy(), batch.column("slice").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            anchor, part, fp, home = now
            start = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
            last = int(start[-1])
            if last:
                whole = start[:-1]
                yield from out(fp[:last], home[:last], whole, np.diff(start))
            homes = int(home[last:].sum())
            if len(fp) - last > 16 * SLICE:
                # a long group: its homes, a slice at most, stay; the others have met them and go
                yield from out(fp[last:], home[last:], np.array([0]), np.array([len(fp) - last]))
                held = tuple(x[last : last + homes] for x in now)
            else:
                held = tuple(x[last:] for x in now)
        if held is not None:
            yield from out(held[2], held[3], np.array([0]), np.array([len(held[2])]))

    return run


def links(distinct: DataFrame, total: int, threshold: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between distinct fingerprints, column fp, that span every component."""
    spark = distinct.sparkSession
    parts = 3 if total <= THREE_PIECES else 2
    rows = distinct.select("fp").mapInArrow(_replicate(threshold, parts), "anchor long, fp long, home boolean")
    crowded = written(distinct.select("fp").mapInArrow(_at_home(parts), "anchor long").groupBy("anchor").count().filter(F.col("count") > SLICE), "crowded")
    n = crowded.count()
    if n:
        # homes go to one slice as such and to the others as visitors
        crowded = crowded.select("anchor", F.ceil(F.col("count") / SLICE).alias("slices"), "count")
        # under 24 bytes an anchor; beyond the bound only those with much of the rows are sent everywhere
        rows = rows.join(F.broadcast(crowded), "anchor", "left") if n <= BROADCAST_ANCHORS else lookup(rows, crowded, "anchor", "count", parts * total)
        rows = rows.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("slices"), F.lit(1)).cast("long") - 1)))
        rows = rows.withColumn("home", F.col("home") & (F.col("slices").isNull() | (F.pmod(F.xxhash64("fp"), F.col("slices")) == F.col("slice"))))
    else:
        rows = rows.withColumn("slice", F.lit(0).cast("long"))
    met = rows.repartition(partitions(spark), "anchor", "slice").sortWithinPartitions("anchor", "slice", F.col("home").desc(), "fp")
    return met.select("anchor", "slice", "fp", "home").mapInArrow(_compare(threshold), "a long, b long")


def _at_home(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(p, np.array([m[0] for m in p.steps(p.codes)], np.uint64)) for p in pieces(parts)]
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for piece, home in tables:
                value = piece.value(fp)
                anchor = (value ^ home[piece.syndrome(value)]).astype(np.int64) + (piece.number << 40)
                yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and root for every node of edges (a, b): root is the least node of the component.

    Large-star and small-star steps in turn, each table written, until nothing changes.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not now.n or now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        both = written(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = written(lookup(both, least, "u", "n", 2 * now.n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        n = large.count()
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        found = lookup(large, least, "u", "n", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(found.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_dedup(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, fingerprint: str | None = None) -> DataFrame:
    """A row for each row of docs: the id column, fp (long), component_id.

    Fingerprints link at ``threshold`` or fewer differing bits; component_id is the smallest id of all rows that can
    be reached by links, the row's own included.  Null and empty texts have fingerprint 0, which links like any
    other; texts with fewer words than a shingle are one shingle; rows that repeat an id are linked alike.  Null ids
    are in components but name none, unless all of a component's ids are null.  ``fingerprint`` names a column that has
    the fingerprints already, of a table that can be read several times.
    """
    if fingerprint:
        rows = docs.select(F.col(id).alias("id"), F.col(fingerprint).alias("fp"))
    else:
        own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        rows = written(fingerprinted(own, shingle=shingle, keep=["id"]), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    totals = distinct.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    roots = components(links(distinct, totals.fps, threshold))
    of = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    groups = written(of.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "groups")
    named = written(lookup(of, groups, "root", "members", totals.fps).select("fp", "n", "component_id"), "named")
    return lookup(rows, named, "fp", "n", totals.rows).select(F.col("id").alias(id), "fp", "component_id")


def representatives(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their component: those with its smallest id.

    A row is judged by its id and its own text, so that an id that repeats with another text goes or stays with each
    text's own component.  Null ids all stay, as do rows that repeat the smallest id; null and empty texts have
    fingerprint 0 and are one component.  An empty table stays empty.
    """
    hash_ = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    own = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), hash_.alias("th"))
    rows = written(fingerprinted(own, keep=["id", "th"]), "fingerprints")
    found = near_dedup(rows, id="id", fingerprint="fp").filter("id <> component_id").select("id", "fp").distinct()
    gone, gone_th, own_th = (free_name(docs.columns, x) for x in ("gone", "gone_th", "own_th"))
    lost = rows.join(found, ["id", "fp"], "left_semi").select(F.col("id").alias(gone), F.col("th").alias(gone_th)).distinct()
    return docs.withColumn(own_th, hash_).join(lost, (F.col(id) == F.col(gone)) & (F.col(own_th) == F.col(gone_th)), "left_anti").drop(own_th)
