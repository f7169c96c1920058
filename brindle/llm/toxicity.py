"""Toxicity by maximum-scoring segments.

Training counts in how many toxic and other documents each word and word beginning occurs and turns the counts into
log-odds under a Dirichlet prior that expects the same rate in both.  A word scores the log-odds of its most telling
beginning, if that is significant, and a small negative drift otherwise.  A linear-time scan finds every maximal
scoring segment of a document, and an extreme-value fit to clean training documents says how surprising the best
one is in a text of that length; a logistic curve turns the surprise into a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import labelled_sample, slices, small_batches, written

#: At most about so many labelled rows are fitted on, chosen by hash of the id; see fit().
SAMPLE_ROWS = 20_000
#: Lengths in characters of the word beginnings that count as features, besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
HEAD = BEGINNINGS[0]
#: Of training texts that share a least hash of so many words in a row, under any of so many hashes, one counts: or
#: else every word that near copies share would look significant.
SHINGLE, HASHES = 5, 3
#: Distinct words that a task remembers the score of.
MEMORY = 50_000
#: Distinct features that a task counts before it passes the counts on.
COUNTED = 200_000
THRESHOLD = 0.7
#: Passages that chance makes more often than so many times in a text aren't significant.
MOST_CHANCE = 0.05

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCORE = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("segments", T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("evidence", T.DoubleType()), T.StructField("e_value", T.DoubleType())]))),
    ]
)
_SCORE_ARROW = pa.struct([("score", pa.float64()), ("segments", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("evidence", pa.float64()), ("e_value", pa.float64())])))])


@dataclass(frozen=True)
class Settings:
    """Chosen by cross-validation between the two training folds; see selection.py."""

    prior: float = 2.0  # pseudo-documents that the prior adds to each feature
    most_z: float = 4.5  # features need this z-score, or less if there are few toxic texts to reach it with
    first_z: float = 2.2  # what they need if one text is toxic, and how much more for e times as many
    z_step: float = 0.46
    least_odds: float = 1.0  # log-odds that a feature needs besides: over many texts, common words get significant as toxic texts are longer
    drift: float = -0.01  # what a word without evidence scores
    power: float = 0.5  # the rarer class weighs as the ratio of the classes to this power

    def least_z(self, toxic: int) -> float:
        return min(self.most_z, self.first_z + self.z_step * math.log(max(toxic, 1)))


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def features_of(word: bytes) -> list[str]:
    """The word itself, marked by a blank, and its beginnings."""
    chars = word.decode("utf-8", "replace").lower()
    return [chars + " ", *(chars[:n] for n in BEGINNINGS if n <= len(chars))]


@dataclass
class Model:
    odds: dict[str, float]  # significant features only
    z: dict[str, float]
    decay: float  # lambda of the extreme-value law of segment scores
    size: float  # its log K
    slope: float
    offset: float
    drift: float = Settings.drift

    def word_score(self, word: bytes) -> float:
        best = max((f for f in features_of(word) if f in self.odds), key=lambda f: (abs(self.z[f]), f), default=None)
        return self.drift if best is None else self.odds[best] + self.drift

    def surprise(self, segment: float, n_words: int) -> float:
        """Log-odds scale of how unlikely the best segment of a clean text is to score so high."""
        return self.decay * segment - self.size - math.log(max(n_words, 1))

    def e_value(self, segment: float, n_words: int) -> float:
        """How many segments that score so high a clean text of that length is expected to have by chance."""
        return math.exp(min(60.0, -self.surprise(segment, n_words)))

    def probability(self, segments: list[tuple[int, int, float]], n_words: int) -> float:
        best = max((s for _, _, s in segments), default=0.0)
        x = self.slope * self.surprise(best, n_words) + self.offset
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal scoring segment (first, length, score), in one pass.

    Only the words with positive scores are visited: between them the running sum falls by what lies there.  A
    segment on the stack holds the running sum before it and after it; a new one joins back to the last that began
    lower, as long as that one also ended lower.
    """
    rising = np.flatnonzero(scores > 0)
    if not len(rising):
        return []
    total = np.cumsum(scores)
    stack: list[tuple[int, int, float, float]] = []
    for i, right, own in zip(rising.tolist(), total[rising].tolist(), scores[rising].tolist(), strict=True):
        first, left = i, right - own
        kept: list[tuple[int, int, float, float]] = stack
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, i, left, right))
    return [(first, last - first + 1, right - left) for first, last, left, right in stack]


class Memory(dict):
    """Scores of the words seen so far.  Words that don't begin as any significant feature are told at once."""

    def __init__(self, model: Model) -> None:
        self.model, self.heads = model, {f[:HEAD] for f in model.odds}

    def __missing__(self, word: bytes) -> float:
        if len(self) >= MEMORY:
            self.clear()
        known = (word.decode("utf-8", "replace").lower() + " ")[:HEAD] in self.heads
        self[word] = score = self.model.word_score(word) if known else self.model.drift
        return score


def scored(words: list[bytes], memory: Memory) -> list[tuple[int, int, float]]:
    return segments_of(np.fromiter(map(memory.__getitem__, words), float, len(words)))


def log_odds(counts: Iterable[tuple[str, int, int]], toxic: int, other: int, settings: Settings = Settings()) -> tuple[dict[str, float], dict[str, float]]:
    """Significant features from (feature, toxic documents, other documents), and their z-scores."""
    odds, zs = {}, {}
    share, prior, least_z = toxic / (toxic + other), settings.prior, settings.least_z(toxic)
    for f, y1, y0 in counts:
        a1, a0 = y1 + prior * share, y0 + prior * (1 - share)
        delta = math.log(a1 / (toxic + prior - a1)) - math.log(a0 / (other + prior - a0))
        z = delta / math.sqrt(1 / a1 + 1 / a0)
        if z >= least_z and delta >= settings.least_odds:
            odds[f], zs[f] = delta, z
    return odds, zs


def calibrate(odds: dict[str, float], zs: dict[str, float], best: np.ndarray, n: np.ndarray, toxic: np.ndarray, settings: Settings = Settings()) -> Model:
    """Extreme-value law of the clean documents' best segments, then the logistic curve.

    best: each training document's best segment score, n: its words.  With scores S, S - ln(n) / lambda follows a
    Gumbel law; lambda comes from the spread by the method of moments, K from the mean.
    """
    clean = best[~toxic]
    spread = max(float(clean.std()) if len(clean) else 0.0, 0.5)
    decay = math.pi / (spread * math.sqrt(6))
    logs = np.log(np.maximum(n, 1))
    size = float(decay * clean.mean() - logs[~toxic].mean() - 0.5772) if len(clean) else 0.0
    x = decay * best - size - logs
    y = toxic.astype(float)
    # Newton steps on two parameters, halved while they overshoot, on a standardised scale
    centre, width = float(x.mean()), max(float(x.std()), 1e-9)
    u = (x - centre) / width

    # the rarer class weighs more: a missed toxic text costs more than a clean one kept out
    weight = np.where(toxic, (max((~toxic).sum(), 1) / max(toxic.sum(), 1)) ** settings.power, 1.0)

    def loss(b: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, (1 - 2 * y) * (b[0] * u + b[1]))).sum() + 0.05 * (b @ b))

    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta[0] * u + beta[1], -30, 30)))
        w = weight * p * (1 - p)
        g = np.array([(weight * (y - p) * u).sum(), (weight * (y - p)).sum()]) - 0.1 * beta
        h = np.array([[(w * u * u).sum() + 0.1, (w * u).sum()], [(w * u).sum(), w.sum() + 0.1]])
        step, now = np.linalg.solve(h, g), loss(beta)
        while abs(step).max() > 1e-9 and loss(beta + step) > now:
            step = step / 2
        beta = beta + step
        if abs(step).max() < 1e-9:
            break
    slope = max(float(beta[0]) / width, 1e-6)
    return Model(odds, zs, decay, size, slope, float(beta[1]) - slope * centre, settings.drift)


def _counts(counts: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["feature", "toxic", "other"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = {}
    for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
        for text, toxic in zip(batch.column("text"), batch.column("label").to_pylist(), strict=True):
            for f in {f for w in set(words_of(text.as_py())) for f in features_of(w)}:
                counts.setdefault(f, [0, 0])[toxic] += 1
            if len(counts) > COUNTED:
                yield _counts(counts)
                counts.clear()
    yield _counts(counts)


def least_hashes(words: list[bytes]) -> list[int]:
    """The least hash of SHINGLE words in a row, under each of HASHES hashes."""
    runs = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return [min(xxhash.xxh64_intdigest(r, seed) for r in runs) >> 1 for seed in range(HASHES)]


def _least_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, "text", 1 << 20)):
        rows = [least_hashes(words_of(text.as_py())) for text in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("label"), pa.array(rows, pa.list_(pa.int64()))], names=["sha", "label", "least"])


def _without_near_copies(rows: DataFrame) -> DataFrame:
    """One row of those that share a least hash, a toxic one if there is any; only digests are shuffled."""
    left = rows.mapInArrow(_least_hashes, "sha string, label int, least array<long>")
    for i in range(HASHES):
        left = left.groupBy(F.get("least", F.lit(i)).alias("m")).agg(F.max(F.struct("label", "sha", "least")).alias("r")).select("r.*")
    # no more rows than the sample has
    return rows.join(F.broadcast(left.select("sha")), "sha", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents, of equal texts and near copies one, toxic if any copy is.

    Over ``sample_rows`` labels, a hash of the id chooses about so many; that bounds what is counted and what the
    driver gathers.  Only text and label are looked at.  Without rows of both labels every text gets the same score.
    """
    small_batches(docs.sparkSession)
    rows = written(labelled_sample(docs, labels, id=id, text=text, label=label, rows=sample_rows), "toxicity_sample")
    rows = written(_without_near_copies(rows).select("text", "label"), "toxicity_rows")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return Model({}, {}, 1.0, 0.0, 0.0, math.log((toxic + 0.5) / (other + 0.5)))
    counts = rows.mapInArrow(_count, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds, zs = log_odds(((r.feature, r.toxic, r.other) for r in counts.filter("toxic >= 3").toLocalIterator()), toxic, other)
    held = rows.sparkSession.sparkContext.broadcast((odds, zs))

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Model(*held.value, 1.0, 0.0, 1.0, 0.0))
        for batch in batches:
            best, n = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                best.append(max((s for _, _, s in scored(words, memory)), default=0.0))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), batch.column("label")], names=["best", "n", "label"])

    found = rows.mapInArrow(best_of, "best double, n long, label int").toPandas().sort_values(["best", "n", "label"])
    held.destroy()
    return calibrate(odds, zs, found.best.to_numpy(), found.n.to_numpy(), found.label.to_numpy() == 1)


def with_score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, by default all) with a struct ``out``: score and segments, the significant
    among the maximal scoring word runs, with evidence in log-odds and E-value, in the order of the text.

    Null and empty texts score as a text without evidence.  A column named as ``out`` is replaced.
    """
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(asdict(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**held.value)
        memory = Memory(own)
        for batch in (part for whole in batches for part in slices(whole, text)):
            found = []
            texts = batch.column(text).cast(pa.binary())
            for i in range(len(texts)):
                words = words_of(texts[i].as_py())
                segments = scored(words, memory)
                passages = [{"first_word": a, "n_words": n, "evidence": s, "e_value": e} for a, n, s in segments if (e := own.e_value(s, len(words))) <= MOST_CHANCE]
                found.append({"score": own.probability(segments, len(words)), "segments": passages})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, _SCORE_ARROW)], names=[*keep, out])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, SCORE)])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def toxic(out: str = "toxicity", threshold: float = THRESHOLD) -> Column:
    return F.col(f"{out}.score") >= threshold
