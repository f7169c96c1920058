"""Removal of repeated byte strings with suffix arrays.

A string of ``length`` bytes is looked for wherever else it starts, in the whole corpus.  Each such window has an
anchor: of the 32-byte strings in it the one with the smallest hash, the first of equals.  Equal windows have equal
anchors, so windows are dealt by anchor, and the windows of one place with one anchor are a segment: they follow one
another and overlap.  Segments whose anchor occurs once are settled, and so are anchors with one distinct segment.
The other segments, each once, go to shards by anchor.  A shard's text gets its suffix array by induced sorting and
its permuted common prefixes, and a window is repeated if it shares ``length`` bytes with a neighbour in the array.

An anchor that many distinct segments share, as at the edge of a passage in a third of all documents, is taken apart:
its windows are dealt again, by the bytes that sixteen neighbouring windows have in common and then, if need be, by
the whole window, where equal keys are equal windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import lookup, partitions, slices, small_batches, written
from brindle.llm.suffix import common_prefixes, suffix_array

LENGTH = 400
#: Bytes of an anchor.
ANCHOR = 32
#: Bytes of text that are looked at, or sorted, at once.
BLOCK = 1 << 20
SHARD = 1 << 21
#: Anchors with more distinct segments are taken apart, by so many windows at a time.
CROWD = 256
STEPS = (16, 1)

RANGES = "array<struct<s:int,e:int>>"
_RUNS = "key long, dg binary, id {id}, th long, p int, nw int, a int"


def _low_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place, in the upper 32 bits; the place in the lower ones."""
    n = len(raw) - ANCHOR + 1
    padded = np.zeros((len(raw) + 15) // 8 * 8, np.uint8)
    padded[: len(raw)] = raw
    word = np.lib.stride_tricks.as_strided(padded.view(np.uint64)[:1], (len(raw) - 7,), (1,)).copy()
    # odd constants from the fraction of the golden ratio and its multiples
    mixed = np.zeros(n, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for k in range(0, ANCHOR, 8):
        mixed = (mixed ^ word[k : k + n]) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(29)
        factor = (factor * 0x9E3779B97F4A7C15 | 1) % (1 << 64)
    return (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(raw: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the documents at [start, end) of raw: document, place of the first window, windows, place of the
    anchor; places count from the start of raw."""
    long = np.flatnonzero(ends - starts >= length)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none
    anchor = (_sliding_min(_low_hashes(np.frombuffer(raw, np.uint8)), length - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = ends[long] - starts[long] - length + 1
    doc = np.repeat(long, windows)
    place = np.repeat(starts[long], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    own = anchor[place]
    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
    return doc[first], place[first], np.diff(np.r_[first, len(own)]), own[first]


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, list[int]]]:
    """Texts in blocks: their numbers, where in its text each begins, the joined bytes, their sizes.  A longer text
    goes in parts that overlap by all but one byte of a window."""
    numbers, offsets, parts, size = [], [], [], 0
    for i, raw in enumerate(texts):
        for at in range(0, max(1, len(raw) - length + 1), BLOCK):
            part = raw[at : at + BLOCK + length - 1] if len(raw) > BLOCK else raw
            numbers.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= BLOCK:
                yield numbers, offsets, b"".join(parts), [len(x) for x in parts]
                numbers, offsets, parts, size = [], [], [], 0
            if len(raw) <= BLOCK:
                break
    if parts:
        yield numbers, offsets, b"".join(parts), [len(x) for x in parts]


def _signed(hashes: list[int]) -> pa.Array:
    return pa.array(np.array(hashes, np.uint64).view(np.int64))


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            for numbers, offsets, raw, sizes in _blocks(texts, length):
                ends = np.cumsum(sizes)
                doc, place, windows, anchor = segments_of(raw, ends - sizes, ends, length)
                if not len(doc):
                    continue
                keys = [xxhash.xxh64_intdigest(raw[a : a + ANCHOR]) for a in anchor.tolist()]
                digests = [xxhash.xxh3_128_digest(raw[p : p + w + length - 1]) for p, w in zip(place.tolist(), windows.tolist(), strict=True)]
                number = np.array(numbers)[doc]
                p = place - (ends - sizes)[doc] + np.array(offsets)[doc]
                take = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [_signed(keys), pa.array(digests, pa.binary()), batch.column("id").take(take), batch.column("th").take(take), pa.array(p.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array((anchor - place).astype(np.int32))],
                    names=["key", "dg", "id", "th", "p", "nw", "a"],
                )

    return run


def _units(runs: DataFrame, name: str, ref: list[str]) -> DataFrame:
    """Distinct segments whose key occurs more than once: key, dg, n (places), ref (one of the places), total (places
    of the key), d (distinct segments of the key).  ``runs`` has key, dg, n and the columns of ref."""
    keys = written(runs.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).filter("total > 1"), f"{name}_keys")
    rows = runs.count()
    shared = lookup(runs, keys, "key", "rows", rows, "inner")
    units = written(shared.groupBy("key", "dg").agg(F.sum("n").alias("n"), F.min(F.struct(*ref)).alias("ref")), f"{name}_units")
    crowds = written(units.groupBy("key").agg(F.count(F.lit(1)).alias("d")), f"{name}_crowds")
    return written(lookup(units, crowds, "key", "d", units.count(), "inner"), f"{name}_all")


def _shard(length: int):
    """Repeated windows of each segment; segments of a key follow one another."""

    def solve(keys: list[int], digests: list[bytes], parts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in parts], np.int64)
        ends = np.cumsum(sizes + 1)
        starts = ends - sizes - 1
        text = np.ones(int(ends[-1]) + 1, np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        inside[-1] = False
        text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 2
        text[-1] = 0
        # places from which a whole window lies in the segment
        live = np.zeros(len(text) + 1, np.int32)
        np.add.at(live, starts, 1)
        np.add.at(live, ends - length, -1)
        live = np.cumsum(live[:-1]) > 0
        before, common = common_prefixes(text, suffix_array(text))
        shared = np.flatnonzero((common >= length) & live)
        shared = shared[live[before[shared]]]
        hit = np.zeros(len(text), bool)
        hit[shared] = True
        hit[before[shared]] = True
        edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        begin, stop = edge[::2], edge[1::2] - 1
        owner = np.searchsorted(starts, begin, side="right") - 1
        found: list[list[dict]] = [[] for _ in parts]
        for o, b, e in zip(owner.tolist(), (begin - starts[owner]).tolist(), (stop - starts[owner]).tolist(), strict=True):
            found[o].append({"s": b, "e": e})
        some = [i for i, x in enumerate(found) if x]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in some], pa.int64()), pa.array([digests[i] for i in some], pa.binary()), pa.array([found[i] for i in some], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["key", "dg", "ranges"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int] = []
        digests: list[bytes] = []
        parts: list[bytes] = []
        size, seen = 0, set()
        for batch in (part for whole in batches for part in slices(whole, "seg")):
            for key, digest, part in zip(batch.column("key").to_pylist(), batch.column("dg").to_pylist(), batch.column("seg").to_pylist(), strict=True):
                if keys and key != keys[-1]:
                    seen.clear()
                    if size >= SHARD:
                        yield solve(keys, digests, parts)
                        keys, digests, parts, size = [], [], [], 0
                if digest in seen:
                    continue  # rows that repeat an id and a text give the same segment again
                seen.add(digest)
                keys.append(key)
                digests.append(digest)
                parts.append(part)
                size += len(part)
        if parts:
            yield solve(keys, digests, parts)

    return run


def _split(length: int, step: int):
    """Segments of crowded keys in runs of windows whose distances to the anchor have one multiple of ``step``; the
    key is what all windows of such a run have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "seg")):
            columns = {k: [] for k in ("key", "dg", "off", "nw", "a")}
            rows = []
            for i, (key, seg, a) in enumerate(zip(batch.column("key").to_pylist(), batch.column("seg").to_pylist(), batch.column("a").to_pylist(), strict=True)):
                windows = len(seg) - length + 1
                at = 0
                while at < windows:
                    block = (a - at) // step
                    last = min(windows - 1, a - block * step)
                    core = seg[a - block * step : a - block * step - step + 1 + length]
                    columns["key"].append(xxhash.xxh64_intdigest(b"%d %d " % (key, block) + core))
                    columns["dg"].append(xxhash.xxh3_128_digest(seg[at : last + length]))
                    columns["off"].append(at)
                    columns["nw"].append(last - at + 1)
                    columns["a"].append(a - at)
                    rows.append(i)
                    at = last + 1
            if rows:
                take = pa.array(rows)
                ints = [pa.array(columns[c], pa.int32()) for c in ("off", "nw", "a")]
                yield pa.RecordBatch.from_arrays([_signed(columns["key"]), pa.array(columns["dg"], pa.binary()), batch.column("n").take(take), batch.column("key").take(take), batch.column("dg").take(take), *ints], names=["key", "dg", "n", "pkey", "pdg", "off", "nw", "a"])

    return run


def _settle(units: DataFrame, segments, length: int, steps: tuple[int, ...], level: int) -> DataFrame:
    """key, dg, ranges (of repeated windows, counted from the segment's first) of the distinct segments that have any.
    ``segments`` takes units and gives them with seg (their bytes) and a (the anchor's distance)."""
    spark = units.sparkSession
    # places with equal segments repeat each other; other segments may share windows with them all the same
    alone = units.filter("d = 1 OR n > 1").select("key", "dg", F.array(F.struct(F.lit(0).alias("s"), (F.col("ref.nw") - 1).cast("int").alias("e"))).alias("ranges"))
    if not steps and level:
        return alone  # keys are whole windows
    text = written(segments(units.filter("d > 1")), f"segments{level}")
    few = text.filter(F.col("d") <= CROWD)
    dealt = few.select("key", "dg", "seg").repartition(partitions(spark), "key").sortWithinPartitions("key", "dg")
    out = alone.unionByName(dealt.mapInArrow(_shard(length), f"key long, dg binary, ranges {RANGES}"))
    crowd = text.filter(F.col("d") > CROWD)
    if crowd.isEmpty():
        return out
    # rows that repeat an id and a text give the same segment again
    crowd = crowd.dropDuplicates(["key", "dg"])
    runs = written(crowd.select("key", "dg", "n", "seg", "a").mapInArrow(_split(length, steps[0]), "key long, dg binary, n long, pkey long, pdg binary, off int, nw int, a int"), f"split{level}")
    finer = _units(runs, f"finer{level}", ["pkey", "pdg", "off", "nw", "a"])

    def cut(wanted: DataFrame) -> DataFrame:
        own = wanted.select("key", "dg", "n", "d", F.col("ref.pkey").alias("pkey"), F.col("ref.pdg").alias("pdg"), F.col("ref.off").alias("off"), F.col("ref.nw").alias("nw"), F.col("ref.a").alias("a"))
        parents = crowd.select(F.col("key").alias("pkey"), F.col("dg").alias("pdg"), F.col("seg").alias("whole"))
        return own.join(parents, ["pkey", "pdg"]).select("key", "dg", "n", "d", "a", F.substring("whole", F.col("off") + 1, F.col("nw") + length - 1).alias("seg"))

    found = _settle(finer, cut, length, steps[1:], level + 1)
    found = _merged(found, f"found{level}")
    parts = lookup(runs.withColumn("unit", F.concat(F.hex("key"), F.hex("dg"))), found.withColumn("unit", F.concat(F.hex("key"), F.hex("dg"))).join(runs.groupBy(F.concat(F.hex("key"), F.hex("dg")).alias("unit")).agg(F.count(F.lit(1)).alias("rows")), "unit").select("unit", "ranges", "rows"), "unit", "rows", runs.count(), "inner")
    up = parts.select(F.col("pkey").alias("key"), F.col("pdg").alias("dg"), F.transform("ranges", lambda r: F.struct((r["s"] + F.col("off")).cast("int").alias("s"), (r["e"] + F.col("off")).cast("int").alias("e"))).alias("ranges"))
    return out.unionByName(up)


def _merged(found: DataFrame, name: str) -> DataFrame:
    """One row for each segment, with its ranges joined where they touch: maximal ones, in order."""

    def join(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when(F.size(done) == 0, F.array(r)).when(r["s"] <= last["e"] + 1, longer).otherwise(F.concat(done, F.array(r)))

    ranges = F.aggregate(F.array_sort(F.flatten(F.collect_set("ranges"))), F.array().cast(RANGES), join)
    return written(found.groupBy("key", "dg").agg(ranges.alias("ranges")), name)


def repeated_spans(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """id, th (a hash of the text) and spans: the byte ranges [s, e) of repeated windows, which may overlap; only for
    rows that have any.  Rows that repeat an id and a text share one row here."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("th", F.xxhash64("text")).withColumn("text", F.col("text").cast("binary"))
    kind = own.schema["id"].dataType.simpleString()
    # shorter texts have no window
    runs = written(own.filter(F.octet_length("text") >= length).mapInArrow(_find(length), _RUNS.format(id=kind)), "runs").withColumn("n", F.lit(1).cast("long"))
    units = _units(runs, "units", ["id", "th", "p", "nw", "a"])

    def fetch(wanted: DataFrame) -> DataFrame:
        places = wanted.select("key", "dg", "n", "d", "ref.*").groupBy("id", "th").agg(F.collect_list(F.struct("key", "dg", "n", "d", "p", "nw", "a")).alias("all"))
        places = places.withColumnRenamed("id", "of").withColumnRenamed("th", "hash")
        rows = own.join(places, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("hash")))
        # cut within the row, so that no segment drags the whole text along
        segment = lambda x: F.struct(x["key"], x["dg"], x["n"], x["d"], x["a"], F.substring(F.col("text"), x["p"] + 1, x["nw"] + length - 1).alias("seg"))
        return rows.select(F.explode(F.transform("all", segment)).alias("x")).select("x.*")

    found = _merged(_settle(units, fetch, length, STEPS, 0), "repeated")
    unit = F.concat(F.hex("key"), F.hex("dg")).alias("unit")
    sizes = units.select(unit, F.col("n").alias("rows"))
    status = written(found.select(unit, "ranges").join(sizes, "unit"), "status")
    hits = lookup(runs.select(unit, "id", "th", "p"), status, "unit", "rows", runs.count(), "inner")
    moved = F.transform("ranges", lambda r: F.struct((F.col("p") + r["s"]).alias("s"), (F.col("p") + r["e"] + length).alias("e")))
    return hits.select("id", "th", moved.alias("spans")).groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _apply(numbers: list[str], keep: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), ("kept", pa.binary())])
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = []
            texts, spans = batch.column("text"), batch.column("spans")
            for i in range(len(texts)):
                raw = texts[i].as_py()
                merged: list[list[int]] = []
                for x in sorted((x["s"], x["e"]) for x in spans[i].as_py() or ()):
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append([*x])
                at, left = 0, []
                for s, e in merged:
                    left.append(raw[at:s])
                    at = e
                rows.append({"n_bytes": len(raw), "n_removed": sum(e - s for s, e in merged), "spans": [{"s": s, "e": e} for s, e in merged], "kept": b"".join([*left, raw[at:]])})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in numbers), pa.array(rows, kind)], names=[*keep, out])

    return run


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", length: int = LENGTH, out: str = "repeats", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, by default all) with a struct ``out``: n_bytes, n_removed, spans (maximal removed
    byte runs), kept (the remaining bytes, which may cut a character).

    A byte is removed if a string of ``length`` bytes that covers it starts anywhere else, in the same document or in
    another; strings don't cross documents, overlapping ones count, and all are judged on the input.  Null is an empty
    text; shorter texts lose nothing; repeated rows are places of their own, so both lose what they share; null ids
    are ids.  A column named as ``out`` is replaced.
    """
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    spans = written(repeated_spans(docs, id=id, text=text, length=length), "spans")
    # kept columns go under numbers, so that none can clash with what is added
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(id).alias("of"), F.xxhash64(raw).alias("hash"), raw.cast("binary").alias("text"))
    rows = own.join(spans, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")), "left")
    kind = T._parse_datatype_string("struct<n_bytes:long,n_removed:long,spans:array<struct<s:long,e:long>>,kept:binary>")
    numbers = [f"k{i}" for i in range(len(keep))]
    return rows.select(*numbers, "text", "spans").mapInArrow(_apply(numbers, keep, out), T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, kind)]))
