"""Quality by ordinal regression on graded ratings.

Words, word shapes and repetitions are hashed into one vector of weights.  A cumulative-link model shares those
weights between all grades and separates the grades by ordered thresholds: P(grade > k) = sigmoid(w.x - t_k).
A text gets its expected grade and the probability of a grade over a chosen one, by which texts are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import labelled_sample, slices, small_batches

#: At most about so many rated rows are fitted on, chosen by hash of the id; see fit().
SAMPLE_ROWS = 8_000
BITS = 18
#: Rounds of the fit.
ROUNDS = 200
#: Distinct words that a task remembers the features of.
MEMORY = 100_000
SELECT = 0.5

#: Lower case letters, zeros for digits, a letter for each byte that isn't ASCII: what a word looks like.
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

SCORE = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())])


@dataclass(frozen=True)
class Settings:
    """Chosen by cross-validation between the two training folds; see selection.py."""

    penalty: float = 1e-3  # on weights
    least_share: float = 0.03  # features in a smaller share of the rows get no weight
    most_share: float = 0.02  # a word's or shape's share of a text counts up to this, so that one word said over and over doesn't decide


def _bucket(name: bytes) -> int:
    return zlib.crc32(name) & ((1 << BITS) - 1)


class Memory(dict):
    """The two features of a word in one number: itself, above its shape with runs of one sign as one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        squeezed = _RUN.sub(rb"\1", word.translate(_SHAPE))
        self[word] = found = _bucket(b"w " + word.translate(_LOWER)) << BITS | _bucket(b"s " + squeezed)
        return found


def features_of(raw: bytes | None, memory: Memory, most_share: float = Settings.most_share) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: shares of its words and shapes, of words said again at once and of words used
    before, and its length in powers of two."""
    words = (raw or b"").split()
    n = len(words)
    length = _bucket(b"n %d" % n.bit_length())
    if not n:
        return np.array([length]), np.array([0.25])
    both = np.fromiter(map(memory.__getitem__, words), np.int64, n)
    buckets, counts = np.unique(np.concatenate([both >> BITS, both & ((1 << BITS) - 1)]), return_counts=True)
    rest = [(b"again", float((both[1:] == both[:-1]).sum()) / n), (b"known", 1 - len(set(words)) / n)]
    return np.r_[buckets, [_bucket(k) for k, _ in rest], length], np.r_[np.minimum(counts / n, most_share), [v for _, v in rest], 0.25]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # one less than grades, rising
    grades: list[int]

    def over(self, x: float | np.ndarray) -> np.ndarray:
        """P(grade > k) for each grade but the last."""
        return 1 / (1 + np.exp(-np.clip(np.asarray(x)[..., None] - self.thresholds, -40, 40)))

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        over = self.over(x)
        steps = np.diff(np.array(self.grades, float))
        return self.grades[0] + over @ steps, over


def fit_matrix(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, settings: Settings = Settings()) -> Model:
    """Fit on hashed rows and their grades.  One grade alone, or none, gives a model that says that grade."""
    kinds = sorted(set(grades.tolist()))
    weights = np.zeros(1 << BITS)
    if len(kinds) < 2:
        return Model(weights, np.zeros(0), [int(k) for k in kinds] or [0])
    y = np.searchsorted(kinds, grades)
    size = np.array([len(b) for b, _ in rows])
    buckets, values = np.concatenate([b for b, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), size)
    held = np.bincount(buckets, minlength=1 << BITS) >= settings.least_share * len(rows)
    buckets, values, row = buckets[held[buckets]], values[held[buckets]], row[held[buckets]]
    used, column = np.unique(buckets, return_inverse=True)
    # features on one scale
    scale = 1 / np.sqrt(np.bincount(column, values**2) / len(rows) + 1e-12)
    values = values * scale[column]
    w = np.zeros(len(used))
    above = np.array([(y > k).mean() for k in range(len(kinds) - 1)])
    logit = np.log((1 - above) / above)
    # rising by construction: the first threshold and the logarithms of the gaps
    gaps = np.log(np.maximum(np.diff(logit), 1e-3))
    free = np.r_[logit[0], gaps]
    mean, square = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    passed = (y[:, None] > np.arange(len(kinds) - 1)).astype(float)
    for step in range(1, ROUNDS + 1):
        x = np.bincount(row, values * w[column], len(rows))
        t = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40)))
        miss = (p - passed) / len(rows)
        gw = np.bincount(column, values * miss.sum(1)[row], len(w)) + settings.penalty * w
        gt = -miss.sum(0)
        gf = np.r_[gt.sum(), [gt[k + 1 :].sum() * np.exp(free[k + 1]) for k in range(len(free) - 1)]]
        g = np.r_[gw, gf]
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
        w -= move[: len(w)]
        free -= move[len(w) :]
    weights[used] = w * scale
    return Model(weights, free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))], [int(k) for k in kinds])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memory = Memory()
    for batch in (part for whole in batches for part in slices(whole, "text")):
        rows = [features_of(t.as_py(), memory) for t in batch.column("text").cast(pa.binary())]
        arrays = [pa.array([b.astype(np.int32).tobytes() for b, _ in rows], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in rows], pa.binary()), batch.column("label")]
        yield pa.RecordBatch.from_arrays(arrays, names=["buckets", "values", "label"])


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", grade: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rated documents, of equal texts one with its highest grade; grades are integers, any number of them.

    Over ``sample_rows`` ratings, a hash of the id chooses about so many; that bounds what the driver gathers: hashed
    features of those texts, eight bytes for each distinct word and shape of a text.  Rows held out are never read.
    """
    small_batches(docs.sparkSession)
    rows = labelled_sample(docs, labels, id=id, text=text, label=grade, rows=sample_rows).select("text", "label")
    found = rows.mapInArrow(_features, "buckets binary, values binary, label int").toPandas().sort_values(["label", "buckets", "values"])
    hashed = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)) for b, v in zip(found.buckets, found["values"], strict=True)]
    return fit_matrix(hashed, found.label.to_numpy().astype(int))


def with_grade(docs: DataFrame, model: Model, *, text: str = "text", over: int | None = None, out: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """docs (its columns ``keep``, by default all) with a struct ``out``: expected_grade, and tail, the probability of
    a grade over ``over`` (by default over the lowest).

    Null and empty texts are judged by their length alone; a column named as ``out`` is replaced.  With a model of a
    single grade, that grade is expected and tail is 0.
    """
    keep = [c for c in keep or docs.columns if c.lower() != out.lower()]
    at = int(np.searchsorted(model.grades, model.grades[0] if over is None else over, side="right")) - 1
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds, model.grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = Model(*held.value), Memory()
        for batch in batches:
            x = np.array([own.weights[b] @ v for b, v in (features_of(t.as_py(), memory) for t in batch.column(text).cast(pa.binary()))], float)
            expected, above = own.score(x)
            tail = above[:, at] if 0 <= at < above.shape[1] else np.full(len(x), float(at < 0))
            found = pa.StructArray.from_arrays([pa.array(np.broadcast_to(expected, len(x)).astype(float)), pa.array(tail.astype(float))], names=["expected_grade", "tail"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, out])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, SCORE)])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def selected(out: str = "quality", least: float = SELECT) -> Column:
    return F.col(f"{out}.tail") >= least
