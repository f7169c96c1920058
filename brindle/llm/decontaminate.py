"""Benchmark decontamination with suffix arrays over the training text.

Every task turns its own documents into shards: their words become numbers, and all suffixes of a shard, from
every word on, are sorted by prefix doubling, as deep as the longest benchmark item can match.  Each suffix of each
benchmark item is then binary-searched in each shard; its range of places with a whole window in common gives the
occurrences, and the common prefix there the longest verbatim matches.  Documents never leave their task, so nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import free_name, slices, small_batches, written

WINDOW = 10
#: Bytes of text in a shard; a longer document is a shard by itself.
SHARD_BYTES = 4 << 20
#: Occurrences that are looked at, at once.
PAIRS = 1 << 20
#: Bytes of benchmark text sent to the executors at once; a larger benchmark goes in several rounds.
ROUND_BYTES = 32 << 20

#: Lower-cases A-Z, keeps digits, letters and all that is not ASCII, and turns the rest into blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("matches", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("n_words", T.LongType())]))),
    ]
)
_HITS_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())])))])


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text; null has none."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Start of every suffix, sorted by its first ``depth`` symbols: places that are tied over some length are sorted by
    the rank of what follows, which doubles the length, until no ties are left or the depth is reached."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, slots, key, length = np.empty(n, np.int64), np.arange(n), text[order], 1
    while True:
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(head, slots, 0))
        rank[order[slots]] = first
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = slots[tied]
        if length >= depth or not len(slots):
            return order
        place = order[slots]
        after = place + length
        key = rank[place] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        order[slots], key = place[by], key[by]
        length *= 2


class Queries:
    """The benchmark's suffixes: all positions at which a window of an item starts."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        lists = [(str(k), w) for k, text in items if (w := words_of(text))]
        self.names = sorted({k for k, _ in lists})
        number = {k: i for i, k in enumerate(self.names)}
        vocabulary: dict[bytes, int] = {}
        flat: list[int] = []
        starts, lengths, owner, offset, ends = [], [], [], [], []
        for k, w in lists:
            size = min(window, len(w))
            for j in range(len(w) - size + 1):
                starts.append(len(flat) + j)
                lengths.append(size)
                owner.append(number[k])
                offset.append(j)
                ends.append(len(flat) + len(w))
            flat += [vocabulary.setdefault(x, len(vocabulary)) for x in w]
        self.vocabulary = list(vocabulary)
        self.flat, self.starts, self.lengths, self.owner, self.offset, self.ends = (np.array(x, np.int64) for x in (flat, starts, lengths, owner, offset, ends))
        self.depth = max((len(w) for _, w in lists), default=0)


class Shard:
    """A block of documents as numbered words with their suffix array, and the benchmark in the same numbers."""

    def __init__(self, lists: list[list[bytes]], queries: Queries) -> None:
        self.queries = queries
        counts = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(counts + 1) - counts - 1
        words = pa.array(list(chain.from_iterable(lists)), pa.binary()).dictionary_encode()
        # a 0 after each document and room for a whole window at the end: no match goes on past them
        self.size = int(counts.sum()) + len(lists)
        self.text = np.zeros(self.size + queries.depth + 1, np.int64)
        self.text[np.arange(counts.sum()) + np.repeat(np.arange(len(lists)), counts)] = words.indices.to_numpy(zero_copy_only=False) + 1
        known = pc.index_in(pa.array(queries.vocabulary, pa.binary()), words.dictionary)
        # words that the shard lacks are a number that its text lacks
        self.flat = (pc.fill_null(known, len(words.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)[queries.flat]
        lacking = np.concatenate([[0], np.cumsum(self.flat > len(words.dictionary))])
        #: windows all of whose words the shard has
        self.asked = np.flatnonzero(lacking[queries.starts + queries.lengths] == lacking[queries.starts])
        if len(self.asked):
            self.order = suffixes(self.text[: self.size], queries.depth)

    def compare(self, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: the suffix at a place against a benchmark suffix, over a window."""
        sign, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
        start, length = self.queries.starts[which], self.queries.lengths[which]
        k = 0
        while len(open_):
            open_ = open_[length[open_] > k]
            gap = self.text[at[open_] + k] - self.flat[start[open_] + k]
            sign[open_] = np.sign(gap)
            open_ = open_[gap == 0]
            k += 1
        return sign

    def search(self, which: np.ndarray, upper: bool) -> np.ndarray:
        """For each benchmark suffix, how many sorted suffixes of the shard come before it (upper: or start with its
        window)."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.size, np.int64)
        live = np.arange(len(which))
        while len(live):
            middle = (low[live] + high[live]) // 2
            sign = self.compare(self.order[middle], which[live])
            before = sign <= 0 if upper else sign < 0
            low[live[before]] = middle[before] + 1
            high[live[~before]] = middle[~before]
            live = live[low[live] < high[live]]
        return low

    def matches(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Longest verbatim matches: benchmark suffixes, places and lengths, some at a time."""
        if not len(self.asked):
            return
        low = self.search(self.asked, False)
        which = self.asked[self.compare(self.order[np.minimum(low, self.size - 1)], self.asked) == 0]
        low = self.search(which, False)
        n = self.search(which, True) - low
        which, low, n = which[n > 0], low[n > 0], n[n > 0]
        upto, q, done = np.cumsum(n), self.queries, 0
        total = int(upto[-1]) if len(n) else 0
        while done < total:
            pair = np.arange(done, min(total, done + PAIRS))
            done += len(pair)
            of = np.searchsorted(upto, pair, side="right")
            place, suffix = self.order[low[of] + pair - (upto - n)[of]], which[of]
            # a match that goes on to the left is found from there
            starts = (q.offset[suffix] == 0) | (place == 0) | (self.text[place - 1] != self.flat[q.starts[suffix] - 1])
            place, suffix = place[starts], suffix[starts]
            length, room = q.lengths[suffix].copy(), (q.ends - q.starts)[suffix]
            live = np.arange(len(place))
            while len(live):
                live = live[length[live] < room[live]]
                live = live[self.text[place[live] + length[live]] == self.flat[q.starts[suffix[live]] + length[live]]]
                length[live] += 1
            yield suffix, place, length


def search_block(lists: list[list[bytes]], queries: Queries) -> list[dict]:
    """The struct HITS for each of a block of documents, given as words."""
    out = [{"n_words": len(x), "n_hit": 0, "items": [], "matches": []} for x in lists]
    if not len(queries.starts) or not any(lists):
        return out
    shard = Shard(lists, queries)
    mark = np.zeros(shard.size + 1, np.int64)
    for suffix, place, length in shard.matches():
        np.add.at(mark, place, 1)
        np.add.at(mark, place + length, -1)
        doc = np.searchsorted(shard.first, place, side="right") - 1
        for d, name, j, p, n in zip(doc.tolist(), queries.owner[suffix].tolist(), queries.offset[suffix].tolist(), (place - shard.first[doc]).tolist(), length.tolist(), strict=True):
            out[d]["matches"].append({"item_id": queries.names[name], "item_word": j, "doc_word": p, "n_words": n})
    hit = np.add.reduceat(np.cumsum(mark[:-1]) > 0, shard.first, dtype=np.int64)
    for d in np.flatnonzero(hit).tolist():
        out[d]["n_hit"] = int(hit[d])
        out[d]["items"] = sorted({m["item_id"] for m in out[d]["matches"]})
        out[d]["matches"].sort(key=lambda m: (m["doc_word"], m["item_id"], m["item_word"]))
    return out


def _merge(a: dict | None, b: dict) -> dict:
    """What two rounds found in one document."""
    if a is None:
        return b
    matches = sorted((*a["matches"], *b["matches"]), key=lambda m: (m["doc_word"], m["item_id"], m["item_word"]))
    hit = end = 0
    for m in matches:
        stop = m["doc_word"] + m["n_words"]
        hit += max(0, stop - max(end, m["doc_word"]))
        end = max(end, stop)
    return {"n_words": b["n_words"], "n_hit": hit, "items": sorted({*a["items"], *b["items"]}), "matches": matches}


def _scan(text_col: str, out: str, held: object, before: str | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries.__new__(Queries)
        queries.__dict__ = held.value
        for batch in (part for whole in batches for part in slices(whole, text_col, SHARD_BYTES)):
            hits = search_block([words_of(x.as_py()) for x in batch.column(text_col).cast(pa.binary())], queries)
            if before:
                hits = [_merge(a, b) for a, b in zip(batch.column(before).to_pylist(), hits, strict=True)]
            arrays = [batch.column(c) for c in keep] + [pa.array(hits, _HITS_ARROW)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, out])

    return run


def with_matches(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, out: str = "decontamination", keep: list[str] | None = None, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """docs (its columns ``keep``, by default all) with a struct ``out``: n_words, n_hit, items, matches.

    A match is a longest verbatim run of words that an item and the document share, with its place in both;
    runs under ``window`` words count only if they are a whole item.  Null and empty texts have no words and
    no hits; an item without words matches nothing; repeated rows are judged one by one; a column of docs
    that is named as ``out`` is replaced.  A null item_id stands as "null".  With an empty benchmark or no
    documents the result has the same columns.

    The benchmark goes to the executors whole up to ``round_bytes``; a larger one is dealt by hash into as
    many rounds as keep that bound, each reading the table the round before wrote.
    """
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("k"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("k") + 16)).first()[0] or 0
    rounds = max(1, -(-size // round_bytes))
    result, before = docs, None
    for r in range(rounds):
        last = r == rounds - 1
        share = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(rounds)) == r) if rounds > 1 else items
        held = spark.sparkContext.broadcast(Queries([(x.k, x.t) for x in share.toLocalIterator()], window).__dict__)
        carried = keep if last or text in keep else [*keep, text]
        name = out if last else free_name(carried, f"{out}_{r}")
        source = result.select(*dict.fromkeys([*keep, text, *([before] if before else [])]))
        schema = T.StructType([*(source.schema[c] for c in carried), T.StructField(name, HITS)])
        result = source.mapInArrow(_scan(text, name, held, before, carried), schema)
        if not last:
            result, before = written(result, "decontamination"), name
    return result


def contaminated(out: str = "decontamination") -> Column:
    return F.col(f"{out}.n_hit") > 0
