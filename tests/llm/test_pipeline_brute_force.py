"""The whole pipeline against a version of its five stages in plain Python, and what its stages leave on disk."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_corpus_operators import brute_components, brute_fingerprint, brute_hits

import corpus_pipeline
from brindle.llm import common, mix, queries, simhash, toxicity

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def tables():
    rng = random.Random(11)
    plain = [f"w{i}" for i in range(400)]
    items = [(f"b{k}", " ".join(rng.choice(plain) for _ in range(rng.choice([4, 14, 30])))) for k in range(12)]
    docs, labels = [], []
    for i in range(500):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 90))]
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        if i % 23 == 1:
            words[3:3] = rng.choice(items)[1].split()
        docs.append([i, " ".join(words), "en", rng.choice(["a", "a", "b", "c", "ü", None]), 0])
        labels.append((i, int(i % 5 == 0)))
    for i in range(500, 560):
        text = docs[rng.randrange(500)][1]
        if i % 2:  # a near copy: many words and a changed one at the end
            text = " ".join((text.split() * 12)[:800]) + rng.choice([" x", " y", ""])
        docs.append([i, text, "en", "b", 0])
    docs += [[560, None, None, "a", 0], [561, "", "en", "c", 0], [562, " \n", "en", None, 0], [7, "an id again", "en", "a", 0], [None, "a text of no id", "en", "a", 0]]
    rng.shuffle(docs)
    return [tuple(d) for d in docs], labels, items


def brute_model(docs, labels):
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    of = {i: v for i, v in labels if fold(i) != 1}
    texts = defaultdict(int)
    for i, t, *_ in docs:
        if i in of:
            texts[t or ""] = max(texts[t or ""], of[i])
    rows = [(v, hashlib.sha256(t.encode()).hexdigest(), toxicity.least_hashes(toxicity.words_of(t)), t) for t, v in texts.items()]
    for k in range(toxicity.HASHES):
        best = {}
        for r in rows:
            best[r[2][k]] = max(r, best.get(r[2][k], r))
        rows = list(best.values())
    counts = defaultdict(lambda: [0, 0])
    for v, _, _, t in rows:
        for f in {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)}:
            counts[f][v] += 1
    toxic = sum(r[0] for r in rows)
    odds, zs = toxicity.log_odds(((f, c[1], c[0]) for f, c in counts.items() if c[1] >= 3), toxic, len(rows) - toxic)
    blank = toxicity.Model(odds, zs, 1.0, 0.0, 1.0, 0.0)
    found = sorted((brute_segment(blank, t)[0], len(toxicity.words_of(t)), v) for v, _, _, t in rows)
    best, n, y = (np.array(x) for x in zip(*found, strict=True))
    return toxicity.calibrate(odds, zs, best.astype(float), n, y == 1)


def brute_segment(model, text):
    """The best sum of words in a row, by Kadane's scan, and the number of words."""
    best = now = 0.0
    words = toxicity.words_of(text)
    for w in words:
        now = max(0.0, now + model.word_score(w))
        best = max(best, now)
    return best, len(words)


def brute_mix(docs):
    weights, sizes = {}, Counter()
    for _, t, _, s, _ in docs:
        sizes[s] += len(mix_words(t))
    for k, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])):
        weights[s] = mix.WEIGHTS[k % 3]
    if None in sizes:
        weights[None] = mix.WEIGHTS[len(weights) % 3]
    left, open_, target = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > 3 * sizes[s]}
        target |= {s: 3.0 * sizes[s] if s in over else left * weights[s] / total for s in (over or open_)}
        left -= sum(3.0 * sizes[s] for s in over)
        open_ = open_ - over if over else set()
    out = Counter()
    for s in sizes:
        whole = min(3, math.floor(target[s] / sizes[s])) if sizes[s] else 0
        rest, used, open_ = target[s] - whole * sizes[s], 0, whole < 3
        hashed = defaultdict(list)
        for d in docs:
            if d[3] == s:
                hashed[hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest()[:12]].append(d)
        for h in sorted(hashed):
            used += sum(len(mix_words(d[1])) for d in hashed[h])
            for d in hashed[h]:
                out[d[:2]] += whole + (open_ and used <= rest)
    return +out


def mix_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    docs, labels, items = tables()
    at = tmp_path_factory.mktemp("pipeline")
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, d, strict=True)) for d in docs], SCHEMA), at / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [i for i, _ in labels], "quality": [1] * len(labels), "toxic": pa.array([v for _, v in labels], pa.int32())}), at / "labels.parquet")
    pq.write_table(pa.table({"item_id": [k for k, _ in items], "text": [t for _, t in items]}), at / "benchmark.parquet")
    return str(at)


def test_pipeline_against_brute_force(spark, folder):
    docs, labels, items = tables()
    model = brute_model(docs, labels)
    sizes = [len(docs)]
    probability = lambda t: model.probability([(0, 0, brute_segment(model, t)[0])], brute_segment(model, t)[1])
    docs = [d for d in docs if probability(d[1]) < toxicity.THRESHOLD]
    sizes.append(len(docs))
    largest = {}
    for d in docs:
        k = d[1] or ""
        if k not in largest or (d[0] is not None and (largest[k][0] is None or d[0] > largest[k][0])):
            largest[k] = d
    docs = list(largest.values())
    sizes.append(len(docs))
    of = brute_components([d[0] for d in docs], [brute_fingerprint(d[1]) for d in docs], simhash.THRESHOLD)
    docs = [d for d, c in zip(docs, of, strict=True) if d[0] is None or d[0] == c]
    sizes.append(len(docs))
    docs = [d for d in docs if next(iter(brute_hits([d], items))).endswith(", 0, [])")]
    sizes.append(len(docs))
    # every stage has had something to do
    assert all(a > b for a, b in zip(sizes, sizes[1:], strict=False)), sizes
    want = brute_mix(docs)
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want
    assert max(want.values()) > 1


def test_pipeline_leaves_other_results_alone(spark, folder):
    before = queries.op3_simhash(spark, folder)
    corpus_pipeline.run(spark, folder).count()
    assert before.count() == len(tables()[0])


def test_scratch_removes_its_own_tables(spark):
    rows = spark.range(5)
    outside = common.written(rows, "outside")
    with common.Scratch(spark) as outer:
        first = common.written(rows, "first")
        with common.Scratch(spark) as inner:
            common.written(rows, "second")
            assert len(inner.paths) == 1 and len(outer.paths) == 1
        assert not os.path.exists(inner.paths[0].removeprefix("file://")) and first.count() == 5
    assert not os.path.exists(outer.paths[0].removeprefix("file://")) and outside.count() == 5


def test_representatives_judge_each_text_of_an_id(spark):
    rng = random.Random(3)
    say = lambda: " ".join(f"x{rng.randrange(10**6)}" for _ in range(80))
    a, b = say(), say()
    rows = [(3, a), (7, a), (7, b), (9, b), (5, None), (6, "")]
    left = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(3, a), (5, None), (7, b)]


def test_near_copies_in_the_fixture_are_linked():
    docs = tables()[0]
    fps = Counter(brute_fingerprint(d[1]) for d in docs)
    assert sum(1 for f in fps for g in fps if f < g and (f ^ g).bit_count() <= 4) > 3
