"""How the settings of the two trained operators were chosen: by cross-validation between the training folds.

    python -m brindle.llm.selection /root/testdata/sf0.1 /root/testdata/sf0.01

Rows whose remainder of crc32(doc_id) is the held-out one are dropped on reading and take no part.  Each setting is
fitted on one of the other two folds and judged on the other, both ways.  Everything is small and runs in one process.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from dataclasses import replace

import numpy as np
import pyarrow.parquet as pq

from brindle.llm import quality, toxicity
from brindle.llm.common import FOLDS, HELD_OUT

TOXICITY = [toxicity.Settings(most_z=z, first_z=9.0, drift=d, prior=p) for z, d, p in itertools.product((3.0, 3.5, 4.0, 4.5, 5.0), (-0.003, -0.01, -0.03, -0.1), (1.0, 2.0))] + [toxicity.Settings(least_odds=o) for o in (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)]
QUALITY = [quality.Settings(penalty=p, least_share=s, most_share=m) for p, s, m in itertools.product((1e-4, 1e-3, 1e-2), (0.01, 0.03), (0.02, 0.1))]


def training_rows(folder: str, label: str) -> list[tuple[int, str, int]]:
    """Fold, text and label of the labelled rows that aren't held out; of equal texts one, with the largest label."""
    marks = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", label]).to_pydict()
    of = {i: v for i, v in zip(marks["doc_id"], marks[label], strict=True) if v is not None}
    docs = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"])
    found: dict[str, tuple[int, int]] = {}
    for i, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        fold = zlib.crc32(str(i).encode()) % FOLDS
        if i in of and fold != HELD_OUT:
            found[text or ""] = (fold, max(of[i], found.get(text or "", (0, of[i]))[1]))
    return [(fold, text, v) for text, (fold, v) in sorted(found.items())]


def without_near_copies(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """As the fit does it: one of those that share a least hash, a toxic one if there is any."""
    seen: list[set[int]] = [set() for _ in range(toxicity.HASHES)]
    kept = []
    for row in sorted(rows, key=lambda r: -r[2]):
        least = toxicity.least_hashes(toxicity.words_of(row[1]))
        if not any(h in s for h, s in zip(least, seen, strict=True)):
            kept.append(row)
            for h, s in zip(least, seen, strict=True):
                s.add(h)
    return kept


def folds_of(rows: list[tuple[int, str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    fold = np.array([f for f, _, _ in rows])
    a, b = (np.flatnonzero(fold == k) for k in range(FOLDS) if k != HELD_OUT)
    return [(a, b), (b, a)]


def toxicity_table(rows: list[tuple[int, str, int]], grid: list[toxicity.Settings]) -> list[tuple[float, float, toxicity.Settings]]:
    """Recall, precision and setting."""
    rows = without_near_copies(rows)
    words, y = [toxicity.words_of(t) for _, t, _ in rows], np.array([v for _, _, v in rows]) == 1
    features = [{f for w in set(x) for f in toxicity.features_of(w)} for x in words]
    out = []
    for setting in grid:
        said = np.zeros(len(rows), bool)
        for train, test in folds_of(rows):
            counts: dict[str, list[int]] = {}
            for k in train:
                for f in features[k]:
                    counts.setdefault(f, [0, 0])[int(y[k])] += 1
            toxic = int(y[train].sum())
            odds, zs = toxicity.log_odds(((f, c[1], c[0]) for f, c in counts.items() if c[1] >= 3), toxic, len(train) - toxic, setting)
            memory = toxicity.Memory(toxicity.Model(odds, zs, 1.0, 0.0, 1.0, 0.0, setting.drift))
            best = np.array([max((s for _, _, s in toxicity.scored(words[k], memory)), default=0.0) for k in train])
            model = toxicity.calibrate(odds, zs, best, np.array([len(words[k]) for k in train]), y[train], setting)
            said[test] = [model.probability(toxicity.scored(words[k], memory), len(words[k])) >= toxicity.THRESHOLD for k in test]
        out.append((float(said[y].mean()), float(y[said].mean()) if said.any() else 0.0, setting))
    return out


def quality_table(rows: list[tuple[int, str, int]], grid: list[quality.Settings]) -> list[tuple[float, quality.Settings]]:
    """Accuracy of the chosen grades and setting."""
    y, memory = np.array([v for _, _, v in rows]), quality.Memory()
    out = []
    for setting in grid:
        hashed = [quality.features_of(t.encode(), memory, setting.most_share) for _, t, _ in rows]
        right = 0
        for train, test in folds_of(rows):
            model = quality.fit_matrix([hashed[k] for k in train], y[train], setting)
            expected, _ = model.score(np.array([model.weights[b] @ v for b, v in (hashed[k] for k in test)]))
            right += int((np.abs(expected - y[test]) < 0.5).sum())
        out.append((right / len(rows), setting))
    return out


def main(folders: list[str]) -> None:
    for folder in folders:
        rows = training_rows(folder, "toxic")
        # with all rows, and with fewer, as the least z-score depends on how many texts are toxic
        for share in (1, 2, 4, 8):
            part = [r for r in rows if zlib.crc32(b"part" + r[1].encode()) % share == 0]
            print(f"{folder}, toxicity, {len(part)} texts, {sum(v == 1 for _, _, v in part)} toxic: recall, precision, F1")
            for recall, precision, setting in toxicity_table(part, TOXICITY if share == 1 else [replace(s, prior=2.0) for s in TOXICITY if s.drift == -0.01 and s.prior == 2.0]):
                print(f"  {recall:.3f} {precision:.3f} {2 * recall * precision / (recall + precision + 1e-9):.3f} {setting}")
        rows = training_rows(folder, "quality")
        print(f"{folder}, quality, {len(rows)} texts: accuracy")
        for accuracy, setting in quality_table(rows, QUALITY):
            print(f"  {accuracy:.4f} {setting}")


if __name__ == "__main__":
    main(sys.argv[1:])
