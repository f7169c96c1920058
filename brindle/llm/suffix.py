"""Suffix arrays by induced sorting, and permuted common prefixes, in array operations.

The passes of induced sorting go over the buckets in order, a stretch of them at a time.  All entries of a stretch
put their predecessors into their buckets at once, in order.  A predecessor that belongs in a later bucket of the
stretch itself ends the stretch there; predecessors in the same bucket, that is, runs of one symbol, are laid out
from the run's end.  So a pass takes few array operations, for small alphabets and for the large ones of the
recursion alike, and its sorts are by counting.
"""

from __future__ import annotations

import numpy as np

#: Entries that a stretch of buckets holds at first; it grows while stretches succeed.
STRETCH = 64


def radix_order(keys: np.ndarray) -> np.ndarray:
    """A stable order of non-negative integers, by 16 bits at a time: numpy sorts those by counting."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    top, shift = int(keys.max()) if len(keys) else 0, 16
    while top >> shift:
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
        shift += 16
    return order


def _small(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one; the last, a sentinel, counts as such."""
    step = np.sign(np.diff(text.astype(np.int64)))
    n = len(step)
    # within a run of equal symbols the step at its end decides
    after = np.where(step != 0, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    return np.r_[step[np.minimum(after, n - 1)] > 0, True] if n else np.array([True])


def _pass(text: np.ndarray, out: np.ndarray, wanted: np.ndarray, run: np.ndarray, start: np.ndarray, end: np.ndarray, edge: np.ndarray, buckets: np.ndarray, step: int) -> None:
    """One pass over the buckets, which come in the pass's order: upward (step 1) or downward (-1).

    Whatever precedes an entry and is ``wanted`` goes to the edge of its symbol's bucket; places not filled yet hold
    -1.  ``run`` says how many equal symbols end at a place.
    """
    weight = np.cumsum((end - start)[buckets])
    in_runs = np.zeros(len(start), bool)
    in_runs[text[run > 1]] = True
    alone = np.flatnonzero(in_runs[buckets])
    stops = [*alone.tolist(), len(buckets)]
    at, stretch, next_stop = 0, STRETCH, 0
    while at < len(buckets):
        past = int(weight[at - 1]) if at else 0
        if stops[next_stop] == at:
            # a bucket with runs: its entries so far end them; what is further from a run's end comes later
            next_stop += 1
            c = int(buckets[at])
            known = out[start[c] : edge[c]] if step > 0 else out[end[c] - 1 : edge[c] : -1]
            length = run[known]
            if len(known) and length.max() > 1:
                member = np.repeat(np.arange(len(known)), length)
                back = np.arange(len(member)) - np.repeat(np.cumsum(length) - length, length)
                by = radix_order(back)
                known = known[member[by]] - back[by]
                if step > 0:
                    out[start[c] : start[c] + len(known)] = known
                else:
                    out[end[c] - len(known) : end[c]] = known[::-1]
                edge[c] = start[c] + len(known) if step > 0 else end[c] - 1 - len(known)
            last, to = c, at + 1
        else:
            to = min(stops[next_stop], max(at + 1, int(weight.searchsorted(past + stretch, side="right"))))
            last = int(buckets[to - 1])
        low, high = (int(start[buckets[at]]), int(end[last])) if step > 0 else (int(start[last]), int(end[buckets[at]]))
        entries = out[low:high] if step > 0 else out[low:high][::-1]
        which = (entries > 0).nonzero()[0]
        before = entries[which] - 1
        good = wanted[before].nonzero()[0]
        before = before[good]
        lands = text[before].astype(np.int32)
        if to == at + 1:
            other = (lands != last).nonzero()[0]
            lands, before = lands[other], before[other]
        elif len(lands):
            clash = int(lands.min()) if step > 0 else int(lands.max())
            if clash <= last if step > 0 else clash >= last:
                # that bucket isn't complete yet, so the stretch ends before it
                room = int(start[clash]) - low if step > 0 else high - int(end[clash])
                n = int(which[good].searchsorted(room))
                before, lands = before[:n], lands[:n]
                to = at + int((buckets[at:to] * step).searchsorted(clash * step))
                stretch = max(STRETCH, 2 * (int(weight[to - 1]) - past))
            else:
                stretch *= 2
        else:
            stretch *= 2
        at = to
        if len(before):
            by = radix_order(lands)
            lands = lands[by]
            head = np.concatenate([_ZERO, (lands[1:] != lands[:-1]).nonzero()[0] + 1])
            n = np.concatenate([head[1:], [len(lands)]]) - head
            kinds = lands[head]
            out[(edge[kinds] - step * head).repeat(n) + step * np.arange(len(lands))] = before[by]
            edge[kinds] += step * n


_ZERO = np.zeros(1, np.int64)


def _induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All suffixes sorted, from the leftmost-smaller ones (``stars``) in order: first the larger ones, from the
    left, then the smaller ones, from the right."""
    n = len(text)
    out = np.full(n, -1, np.int32)
    places = np.arange(n, dtype=np.int32)
    run = places - np.maximum.accumulate(np.where(np.concatenate([[True], text[1:] != text[:-1]]), places, 0)) + 1
    used = np.flatnonzero(end > start)
    # leftmost-smaller suffixes stand at the ends of their buckets until the larger ones are in
    edges = np.searchsorted(text[stars], np.arange(len(start) + 1))
    of = text[stars].astype(np.int64)
    at = end[of] - edges[of + 1] + np.arange(len(stars))
    out[at] = stars
    _pass(text, out, ~small, run, start, end, start.copy(), used, 1)
    out[at] = -1
    _pass(text, out, small, run, start, end, end - 1, used[::-1], -1)
    out[0] = n - 1
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start of every suffix in order; text is of non-negative integers and ends with its only 0."""
    n = len(text)
    if n < 3:
        return np.arange(n)[::-1].copy()
    small = _small(text)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(text)
    end = np.cumsum(size)
    start = end - size
    # leftmost-smaller substrings, sorted by inducing from their first symbols
    order = _induce(text, small, stars[radix_order(text[stars].astype(np.int64))], start, end)
    is_star = np.zeros(n, bool)
    is_star[stars] = True
    order = order[is_star[order]]
    # equal neighbours get one name
    number = np.empty(n, np.int64)
    number[stars] = np.arange(len(stars))
    length = np.diff(np.r_[stars, n - 1]) + 1
    i = number[order]
    same = np.zeros(len(order), bool)
    same[1:] = length[i[1:]] == length[i[:-1]]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[i[live]] > k]
        differ = text[order[live] + k] != text[order[live - 1] + k]
        same[live[differ]] = False
        live, k = live[~differ], k + 1
    name = np.cumsum(~same) - 1
    if len(order) and name[-1] + 1 < len(order):
        reduced = np.empty(len(stars), np.int64)
        reduced[i] = name
        order = stars[suffix_array(reduced)]
    return _induce(text, small, order, start, end)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place: the suffix before it in the array (-1: none), and how many symbols the two have in common.

    If the symbols before the two are equal as well, the common prefix is that of the place before, less one; only
    at the other places symbols are compared, several at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    per = 4  # symbols of two bytes that are compared at once
    padded = np.zeros(n + per, np.uint16)
    padded[:n] = text
    word = np.lib.stride_tricks.as_strided(padded.view(np.uint64)[:1] if len(padded) % per == 0 else padded[: len(padded) // per * per].view(np.uint64)[:1], (n,), (2,))
    prev = before
    fresh = prev < 0
    inner = np.flatnonzero(~fresh)
    head = inner[(inner == 0) | (prev[inner] == 0)]
    inner = inner[(inner > 0) & (prev[inner] > 0)]
    fresh[inner[text[inner - 1] != text[prev[inner] - 1]]] = True
    fresh[head] = True
    at = np.flatnonzero(fresh & (prev >= 0))
    common = np.zeros(n, np.int64)
    live, k = at, 0
    while len(live):
        gap = word[live + k] ^ word[prev[live] + k]
        differ = gap != 0
        low = gap[differ]
        common[live[differ]] = k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 16
        live, k = live[~differ], k + per
    base = np.where(fresh, np.arange(n), 0)
    base = np.maximum.accumulate(base)
    return before, common[base] - (np.arange(n) - base)
