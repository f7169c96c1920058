"""The corpus operators against brute force, and their edge cases: nulls, empty and long texts, repeated rows, empty
tables, extra columns with clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import chat, decontaminate, exact_dedup, licenses, mix, quality, queries, repeats, simhash, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéfgh") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = say(120)
    texts = [say(rng.randint(1, 200)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[3], None, "", "", " \n", "x" * 1500, "ab " * 700, say(3000)]
    texts += [f"{say(20)}\n{passage} {say(15)}" for _ in range(8)]
    words = texts[5].split() * 3
    words[10:11] = ["edited"]
    texts += [" ".join(texts[5].split() * 3), " ".join(words), passage.upper()]
    rows = [(i, t, "en", rng.choice(["a", "b", "ü", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [(0, texts[0], "en", "a", 1), (7, "other text of a repeated id", "en", "b", 1), (None, "text of a null id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def clashing(df):
    names = ("id", "th", "size", "h", "out", "kept", "keep_id", "fp", "decontamination", "toxicity", "repeats", "licenses", "quality", "copies", "own_sha", "gone", "of")
    return df.withColumns({n: F.lit(7) for n in names})


def rows_of(df):
    return Counter(map(str, df.collect()))


# Suffix arrays


@pytest.mark.parametrize("stretch", [1, 4, 64])
def test_suffix_array(monkeypatch, stretch):
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(300):
        raw = [rng.randrange(rng.choice([1, 2, 4, 200, 5000])) for _ in range(rng.randrange(90))]
        raw = raw[: rng.randrange(1, 6)] * 8 if rng.random() < 0.3 else raw
        text = np.array([x + 1 for x in raw] + [0], np.uint16)
        found, symbols = suffix.suffix_array(text), list(text)
        assert list(found) == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        before, common = suffix.common_prefixes(text, found)
        for a, b in zip(found, found[1:], strict=False):
            k = next(k for k in range(len(symbols)) if symbols[a + k] != symbols[b + k])
            assert before[b] == a and common[b] == k


def test_suffixes_to_a_depth():
    rng = random.Random(4)
    for _ in range(200):
        symbols = [rng.randrange(rng.choice([1, 3, 300])) for _ in range(rng.randrange(1, 80))]
        for depth in (1, 2, 3, 10, 100):
            found = decontaminate.suffixes(np.array(symbols, np.int64), depth)
            assert sorted(found) == list(range(len(symbols)))
            assert [symbols[i : i + depth] for i in found] == sorted(symbols[i : i + depth] for i in range(len(symbols)))


# Mixing


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5000), (None, 50), ("d", 0)], "source string, source_size long")
    found = {r.source: r.target for r in mix.targets(sizes).collect()}
    size = {"a": 10, "b": 1000, "c": 5000, "d": 0, None: 50}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    # sources are filled one after another until none is above its cap
    left, open_, want = float(sum(size.values())), set(size), {}
    while True:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * size[s]}
        if not over:
            want |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3.0 * size[s]
        left -= sum(want[s] for s in over)
        open_ -= over
    assert found == pytest.approx(want)


def test_mix_takes_by_hash(spark, docs):
    found = mix.mix(clashing(docs)).collect()
    assert len(found) == docs.count()
    taken, target, whole = Counter(), {}, {}
    for (i, t, _, s, _), r in zip(sorted(corpus(), key=str), sorted(found, key=lambda r: str(r.doc_id)), strict=False):
        pass
    by = {r.doc_id: r for r in found}
    for i, t, _, s, _ in corpus():
        r = by[i]
        if i not in (0, 7):
            assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            assert r.taken == r.size * r.copies <= 3 * r.size
        target[s] = r.target if i not in (0, 7) else target.get(s, r.target)
    for r in found:
        taken[round(r.target, 6), r.source_size] += r.taken
    for (goal, size), got in taken.items():
        assert got <= goal + 1e-6 and (got > goal - 3100 or got == 3 * size)
    assert rows_of(mix.mix(docs)) == rows_of(mix.mix(clashing(docs)))
    repeated = mix.mixed_rows(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.copies for r in found)
    assert mix.mix(docs.limit(0)).count() == 0 and mix.mixed_rows(docs.limit(0)).count() == 0


# Repeated strings


def brute_repeats(rows, length):
    count = Counter()
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[j : j + length] for j in range(len(b) - length + 1))
    out = []
    for i, t, *_ in rows:
        b, spans = (t or "").encode(), []
        for j in range(len(b) - length + 1):
            if count[b[j : j + length]] > 1:
                if spans and j <= spans[-1][1]:
                    spans[-1][1] = j + length
                else:
                    spans.append([j, j + length])
        kept, at = b"", 0
        for s, e in spans:
            kept, at = kept + b[at:s], e
        out.append((i, len(b), sum(e - s for s, e in spans), len(spans), kept + b[at:]))
    return Counter(map(str, out))


@pytest.mark.parametrize(("crowd", "block"), [(256, 1 << 20), (2, 700)])
def test_repeats(spark, docs, monkeypatch, crowd, block):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "SHARD", block)
    found = repeats.without_repeats(clashing(docs), length=100, out="r").collect()
    got = Counter(str((x.doc_id, x.r.n_bytes, x.r.n_removed, len(x.r.spans), bytes(x.r.kept))) for x in found)
    assert got == brute_repeats(corpus(), 100)


def test_ranges_of_a_crowd_stay_few(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 16)
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = say(1000)
    most, found = [], []
    for n in (12, 90):
        rows = [(i, say(300) + passage + say(300)) for i in range(n)]
        spans = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert len(spans) == n
        most.append(max(len(r.spans) for r in spans))
        found.append({(min(x.s for x in r.spans) <= 300, max(x.e for x in r.spans) >= 1300) for r in spans})
    # a range for each segment and neighbour, however many documents share the passage
    assert found == [{(True, True)}] * 2 and most[1] <= 2 * most[0] + 4, most


def test_repeats_of_nothing(spark, docs):
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    short = repeats.without_repeats(docs.filter("length(text) < 50"), keep=["doc_id"]).collect()
    assert short and all(r.repeats.n_removed == 0 for r in short)


# SimHash


def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, threshold):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = defaultdict(list)
    for g, i in zip(group, ids, strict=True):
        if i is not None:
            least[g].append(i)
    return [min(least[g]) if least[g] else None for g in group]


def test_simhash(spark, docs):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = Counter(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps, 4), strict=True))
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_dedup(clashing(docs)).collect())
    assert got == want
    assert simhash.near_dedup(docs.limit(0)).count() == 0
    left = simhash.representatives(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {c for _, _, c in want} | {None}


@pytest.mark.parametrize("slice_", [2, 4096])
@pytest.mark.parametrize("parts", [2, 3])
def test_links_of_dense_and_random_fingerprints(spark, monkeypatch, slice_, parts):
    monkeypatch.setattr(simhash, "SLICE", slice_)
    monkeypatch.setattr(simhash, "THREE_PIECES", 0 if parts == 2 else 1 << 26)
    rng = random.Random(parts)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(4):
            fps.add(base)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                base ^= 1 << b
    centre = rng.getrandbits(64)
    fps |= {centre ^ 1 << b for b in range(30)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(table, len(fps))).collect()}
    got = defaultdict(set)
    for f in signed:
        got[roots.get(f, f)].add(f)
    want = defaultdict(set)
    for f, c in zip(signed, brute_components(signed, fps, 4), strict=True):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# Decontamination


def brute_hits(rows, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[j : j + n])].add("null" if k is None else str(k))
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    found |= wins[tuple(w[j : j + n])]
        out.append(str((i, len(w), len(hit), sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("round_bytes", [1 << 25, 700])
def test_decontaminate(spark, docs, round_bytes):
    rows = corpus()
    items = [(1, " ".join(rows[2][1].split()[:30])), (2, rows[62][1]), (3, "Abc"), (4, None), (5, "..."), (6, rows[-5][1]), (6, rows[9][1][:200]), (None, "  " + rows[11][1].upper())]
    items += [(100 + k, rows[k][1]) for k in range(20, 30)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.with_matches(clashing(docs), benchmark, out="d", round_bytes=round_bytes).collect()
    assert Counter(str((r.doc_id, r.d.n_words, r.d.n_hit, r.d["items"])) for r in found) == brute_hits(rows, items)
    for r in found:
        w = decontaminate.words_of(r.text)
        for m in r.d.matches:
            texts = [decontaminate.words_of(t) for k, t in items if str(k) == m.item_id or k is None and m.item_id == "null"]
            assert any(w[m.doc_word : m.doc_word + m.n_words] == t[m.item_word : m.item_word + m.n_words] for t in texts)
    assert decontaminate.with_matches(docs, benchmark.limit(0)).filter("decontamination.n_hit > 0").count() == 0
    assert decontaminate.with_matches(docs.limit(0), benchmark).count() == 0


# Exact dedup


def test_exact_dedup(spark, docs):
    rows = corpus()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    found = exact_dedup.exact_dedup(clashing(docs)).collect()
    assert len(found) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    for r in found:
        assert (r.keep_id, r.group_size) == sha[r.text_sha256]
    assert Counter(r.text_sha256 for r in found if r.kept) == Counter(sha.keys())
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    left = exact_dedup.kept_rows(docs)
    assert left.columns == docs.columns and Counter((r.text or "") for r in left.collect()) == Counter(groups.keys())
    assert exact_dedup.kept_rows(clashing(docs)).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_digest_index_keeps_earlier_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "test_digest_index", f"file://{tmp_path}/index", 3)
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    first, _ = index.add(make((1, "a"), (2, "a"), (3, "b")))
    assert {r.doc_id for r in first.collect() if r.kept} == {2, 3}
    second, groups = index.add(make((9, "a"), (10, "c"), (11, None)))
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {9: (2, False), 10: (10, True), 11: (11, True)}
    assert {r.known for r in groups.filter("keep_id = 2").collect()} == {True}
    assert index.entries().count() == 4


# Licenses


def brute_licenses(t):
    w, out = licenses.words_of(t or ""), []
    for kind, own in licenses.kinds_of(licenses.TEMPLATES).items():
        shingles = licenses.shingles_of(w, kind.shingle)
        for i in range(0, len(shingles), kind.stride):
            window = shingles[i : i + kind.width]
            for name, x in own:
                share = sum(s in set(window) for s in x) / len(x)
                if share >= licenses.LEAST:
                    out.append((i, name, len(window) + kind.shingle - 1, share))
    return sorted(out)


def test_licenses(spark):
    rng = random.Random(3)
    notices = [t for _, t in licenses.TEMPLATES]
    filler = lambda k: " ".join(rng.choice(["software", "the", "license", "foo", "reserved"]) for _ in range(k))
    texts = [None, "", "license", *notices, *(f"{filler(30)}\n{rng.choice(notices).upper()}\n{filler(40)}" for _ in range(20))]
    for _ in range(20):
        w = rng.choice(notices).split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(f"{filler(9)} {' '.join(w)} {filler(9)}")
    df = clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found = {r.doc_id: sorted((m.first_word, m.license, m.n_words, m.containment) for m in r.found) for r in licenses.with_licenses(df, out="found").collect()}
    assert found == {i: brute_licenses(t) for i, t in enumerate(texts)}
    assert all(found[3 + i] for i in range(len(notices)))
    assert licenses.with_licenses(df.limit(0)).count() == 0
    assert licenses.with_licenses(df, []).filter("size(licenses) > 0").count() == 0


def test_license_bands_suffice(spark):
    for kind, templates in licenses.kinds_of(licenses.TEMPLATES).items():
        for _, own in templates:
            # the worst window: the least that matches, and nothing else that the template has
            common = -(-8 * len(own) // 10)
            resemblance = common / (kind.width + len(own) - common)
            assert resemblance >= 1 or (1 - resemblance) ** kind.bands <= licenses.MISS
    shingles = ["a b c d e", "é 1 2 3 4", "x"]
    hashes = F.array(*(F.xxhash64(F.lit(x)) for x in shingles))
    bands = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")), lambda b: F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, b))))
    assert spark.range(1).select(bands.alias("b")).first().b == licenses.signature_of(shingles, 7)


def test_licenses_in_long_and_repeated_texts(spark):
    filler = " ".join(f"word{i % 977} license software" for i in range(20000))
    texts = [f"{filler} Released under the MIT License. {filler}"] * 2 + [filler]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    found = licenses.with_licenses(df, out="found", keep=["doc_id"]).collect()
    assert sorted((r.doc_id, {m.license for m in r.found} >= {"MIT"}) for r in found) == [(1, True), (1, True), (2, False)]
    assert sorted((m.first_word, m.license, m.n_words, m.containment) for m in found[0].found) == brute_licenses(texts[0])


# Toxicity


def test_segments_are_maximal():
    rng = random.Random(5)
    for _ in range(200):
        scores = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) for _ in range(rng.randrange(1, 14))], float)

        def best(lo, hi):
            spans = [(scores[a:b].sum(), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            top = max(spans, default=(0,))
            if top[0] <= 0:
                return []
            return [*best(lo, top[3]), (top[3], top[4]), *best(top[4], hi)]

        got = toxicity.segments_of(scores)
        want = best(0, len(scores))
        assert [round(s, 6) for _, _, s in got] == [round(scores[a:b].sum(), 6) for a, b in want]
        assert all(abs(scores[a : a + n].sum() - s) < 1e-9 for a, n, s in got)


def labelled(n=400):
    rng = random.Random(9)
    plain = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "rotten"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), min(3, i % 5)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    rows += [(1000, None), (1001, ""), (None, "vile " * 20), (1002, "nasty " * 5000)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    marks = spark.createDataFrame([*labels, (None, 1, 0), (1000, None, None)], "doc_id long, toxic int, grade int")
    model = toxicity.fit(docs, marks)
    found = {r.doc_id: r for r in toxicity.with_score(docs, model, out="t").collect()}
    wrong = sum((found[i].t.score >= 0.7) != bool(t) for i, t, _ in labels)
    assert wrong <= 4 and 0 <= found[1000].t.score == found[1001].t.score < 0.5
    assert all(0 <= r.t.score <= 1 for r in found.values())
    assert any("vile" in " ".join(r.text.split()[s.first_word : s.first_word + s.n_words]) for r in found.values() if r.text for s in r.t.segments)
    assert toxicity.with_score(docs.limit(0), model).count() == 0
    flat = toxicity.fit(docs, marks.limit(0))
    assert len({r.toxicity.score for r in toxicity.with_score(docs, flat).collect()}) <= 3
    again = toxicity.fit(docs, marks)
    assert (again.odds, again.slope) == (model.odds, model.slope)


def test_toxicity_over_many_texts():
    """Toxic texts are longer here, so each common word is significant; none of them may count as evidence."""
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.1
    words = [rng.integers(0, 150, rng.integers(50, 600) + 60 * toxic).tolist() for toxic in y]
    texts = [[b"w%03d" % w for w in found] for found in words]
    for text, toxic in zip(texts, y, strict=True):
        if toxic:
            text[len(text) // 2 : len(text) // 2 + 2] = [b"idiot", b"moron"]
    counts = {}
    for text, toxic in zip(texts, y, strict=True):
        for f in {f for w in set(text) for f in toxicity.features_of(w)}:
            counts.setdefault(f, [0, 0])[int(toxic)] += 1
    odds, zs = toxicity.log_odds(((f, c[1], c[0]) for f, c in counts.items()), int(y.sum()), int((~y).sum()))
    memory = toxicity.Memory(toxicity.Model(odds, zs, 1.0, 0.0, 1.0, 0.0))
    found = [toxicity.scored(text, memory) for text in texts]
    n = np.array([len(text) for text in texts])
    model = toxicity.calibrate(odds, zs, np.array([max((s for _, _, s in f), default=0.0) for f in found]), n, y)
    said = np.array([model.probability(f, k) >= toxicity.THRESHOLD for f, k in zip(found, n, strict=True)])
    assert not any(f.startswith("w") for f in odds)
    assert said[y].mean() > 0.99 and said[~y].mean() < 0.01


def test_ordinal_regression_orders_grades(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        grade = i % 4
        words = [rng.choice(["good", "fine"] if rng.random() < grade / 3 else ["bad", "poor"]) + rng.choice("abc") for _ in range(60)]
        rows.append((i, " ".join(words)))
        marks.append((i, grade))
    rows += [(9000, None), (9001, "")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    found = {r.doc_id: r.q for r in quality.with_grade(docs, model, over=1, out="q").collect()}
    assert sum(abs(found[i].expected_grade - g) < 0.75 for i, g in marks) > 540
    assert sum((found[i].tail >= 0.5) == (g > 1) for i, g in marks) > 540
    assert found[9000] == found[9001] and 0 <= found[9000].tail <= 1
    one = quality.fit_matrix([], np.zeros(0, int))
    assert {r.quality.tail for r in quality.with_grade(docs, one).collect()} == {0.0}
    assert quality.with_grade(docs.limit(0), model).count() == 0


def test_grades_of_long_repeated_and_contested_texts(spark):
    rng = random.Random(4)
    say = lambda grade, n=50: " ".join(rng.choice(["good", "fine"] if grade else ["bad", "poor"]) + rng.choice("abc") for _ in range(n))
    rows = [(i, say(i % 2)) for i in range(300)]
    marks = [(i, i % 2) for i in range(300)]
    # equal texts with different grades count once, with the highest; repeated rows are graded alike
    contested = say(1)
    rows += [(1000 + i, contested) for i in range(6)] + [(2000, say(1, 30000)), (2000, say(0, 30000)), (2001, "x" * 200_000), (0, rows[0][1])]
    marks += [(1000 + i, int(i == 5)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    found = [(r.doc_id, r.text, r.quality) for r in quality.with_grade(docs, model).collect()]
    assert len(found) == len(rows)
    long = {t[:4]: q.expected_grade for i, t, q in found if i == 2000}
    assert min(long["good"] if "good" in long else 2, long.get("fine", 2)) > 0.5 > max(long.get("bada", 0), 0)
    assert len({q for i, _, q in found if 1000 <= i < 1006}) == 1 and next(q for i, _, q in found if i == 1000).expected_grade > 0.5
    assert len({q for i, _, q in found if i == 0}) == 1
    # the whole of a word without blanks counts, not its beginning
    memory = quality.Memory()
    head = b"a" * 70
    assert memory[head + b"1"] != memory[head + b"!"]


# Web archive


def test_warc_of_long_and_repeated_rows(spark):
    long = "é<p>" * 200_000
    rows = [(1, "u", long), (1, "u", long), (1, "u", long), (2, "v", long), (3, "w", "short"), (3, "w", "short")]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    records = archive.records().collect()
    assert len(records) == 6 and len({r.record_id for r in records}) == 6
    read = warc.read_records(archive).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in read) == Counter({(1, "revisit", 2): 3, (2, "response", None): 1, (3, "response", None): 2})
    assert {r.payload_digest for r in read if r.page_id < 3} == {hashlib.sha1(long.encode()).hexdigest()}
    whole = {r.record_id: bytes(r.record) for r in warc.rebuild(archive).collect()}
    assert len(whole) == 6 and sum(long.encode() in x for x in whole.values()) == 1


def test_warc(spark):
    big, big2 = "<p>é</p>" * 300, "b" * 1000
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, "small"), (4, "http://d\r\nX: y", "small"), (5, "http://e", None), (6, "http://f", ""), (7, "u", big2), (7, "u", big2), (9, "g", "text\r\n\r\nWARC/1.1\r\n"), (None, "h", big)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    archive = warc.write_archive(pages)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(archive).collect())
    want = Counter()
    for i, _, t in rows:
        b = (t or "").encode()
        top = max((k for k, _, u in rows if (u or "") == (t or "") and k is not None), default=None)
        again = len(b) >= 1000 and i != top
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert got == want
    assert archive.payloads().count() == len({t or "" for _, _, t in rows})
    records = [bytes(r.record) for r in warc.rebuild(archive).collect()]
    assert len(records) == len(rows)
    for r in records:
        head, _, rest = r.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(re.search(rb"\r\nContent-Length: (\d+)", head)[1]) == len(rest) - 4
    assert warc.read_records(warc.write_archive(pages.limit(0))).count() == 0


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "a", "x\r\n\r\ny"), (2, "b", "é" * 600), (3, "c", "é" * 600)], "page_id long, url string, html string")
    archive = warc.write_archive(pages)
    warc.export_files(archive, f"file://{tmp_path}/files")
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("part-*")))
    assert sorted(bytes(r.record) for r in warc.rebuild(archive).collect()) == sorted(b"WARC/1.1\r\n" + x for x in raw.split(b"WARC/1.1\r\n")[1:])


def test_warc_notices_damage(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "a", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/a")
    bad = archive.payloads().withColumn("payload", F.lit(b"y")).collect()
    spark.createDataFrame(bad, "payload_sha256 string, payload binary").write.mode("overwrite").parquet(f"file://{tmp_path}/a/payloads")
    with pytest.raises(Exception):  # noqa: B017
        warc.read_records(archive).collect()


# Chats


def test_chats(spark):
    odd = "␛1</s>[INST] a [/INST]<<SYS>>[ROLE] ␛"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", odd), (1, 2, "assistant", odd + "\n"), (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, "assistant", ""), (3, 2, "tool [ROLE]", odd), (4, 1, "user", "b"), (4, 1, "user", "a"), (None, 0, "user", " lead"), (5, None, None, None)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = chat.format_chats(df).withColumn("text", chat.formatted(F.col("segments")))
    got = {r.conv_id: r for r in found.withColumn("back", chat.parsed(F.col("text"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        assert [(t.role, t.text) for t in got[conv].back] == [(r, x) for _, _, r, x in turns]
        assert got[conv].loss == "".join(x for _, _, r, x in turns if r == "assistant")
    assert (got[1].state, got[1].complete, got[2].state, got[3].state, got[None].complete) == ("assistant", True, "error", "error", False)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_of_a_very_long_text(spark):
    text = "</s>[INST] é␛ " * 60_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    found = chat.format_chats(df).withColumn("text", chat.formatted(F.col("segments")))
    r = found.withColumn("back", chat.parsed(F.col("text"))).withColumn("loss", chat.loss_text(F.col("segments"))).first()
    assert [t.text for t in r.back] == ["q", text, text] and r.loss == text * 2 and r.state == "error"


def test_digest_index_compacts(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "test_compacted_index", f"file://{tmp_path}/index", 3)
    for k in range(3):
        index.add(spark.createDataFrame([(10 * k + i, f"t{k}{i}") for i in range(9)] + [(99, "again")], "doc_id long, text string"))
    before = sorted(index.entries().collect())
    index.compact()
    assert sorted(index.entries().collect()) == before and len(before) == 28
    assert len(index.entries().inputFiles()) <= 3
    last, _ = index.add(spark.createDataFrame([(1000, "t11"), (1001, "new")], "doc_id long, text string"))
    assert {r.doc_id: r.kept for r in last.collect()} == {1000: False, 1001: True}
    index.drop()


# Queries


def test_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
