"""Suffix arrays of integer sequences by prefix doubling, and longest common prefixes, both in linear memory."""

from __future__ import annotations

import numpy as np


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes.

    `ids` are 0, 1, ...; its last symbol, and whatever ends a part of it, occurs once. A round ranks suffixes by twice
    as many symbols as the one before; only positions that are still tied take part, and only the last ranks are kept.
    """
    counts = np.bincount(ids)
    starts = np.cumsum(counts) - counts
    rank = starts[ids].astype(np.int32)
    tied = np.flatnonzero(counts[ids] > 1).astype(np.int32)
    width = 1
    while len(tied):
        key = rank[tied].astype(np.int64)
        key *= len(ids)
        key += rank[tied + width]
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        del order
        at = np.arange(len(tied), dtype=np.int32)
        old = rank[tied]
        first_old = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        is_new = np.r_[True, key[1:] != key[:-1]]
        del key
        first_new = np.maximum.accumulate(np.where(is_new, at, 0))
        rank[tied] = old + first_new - first_old
        single = is_new & np.r_[is_new[1:], True]
        tied = tied[~single]
        width *= 2
    order = np.empty(len(ids), np.int32)
    order[rank] = np.arange(len(ids), dtype=np.int32)
    return order


def common_prefixes(ids: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = 1 << 16) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at `a` and at `b`, pair by pair (a != b).

    Pairs that still agree are compared over twice as many symbols in the next round.
    """
    length = np.zeros(len(a), np.int64)
    live, width, last = np.arange(len(a)), 8, len(ids) - 1
    while len(live):
        left = []
        step = max(1, cells // width)
        for at in range(0, len(live), step):
            part = live[at : at + step]
            ahead = length[part, None] + np.arange(width)
            unlike = ids[np.minimum(a[part, None] + ahead, last)] != ids[np.minimum(b[part, None] + ahead, last)]
            ends = unlike.any(axis=1)
            length[part] += np.where(ends, unlike.argmax(axis=1), width)
            left.append(part[~ends])
        live, width = np.concatenate(left), min(2 * width, cells)
    return length


def previous_prefixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the one before it in the suffix array (-1 for the first) and the length of their longest common prefix.

    Where a position and its neighbour follow the same symbol, the common prefix is one shorter than the one a place
    before; only the others are compared, whose prefixes have n log n symbols in all.
    """
    order = suffix_array(ids)
    before = np.full(len(ids), -1, np.int32)
    before[order[1:]] = order[:-1]
    del order
    places = np.arange(len(ids), dtype=np.int32)
    head = np.ones(len(ids), bool)  # whether the place's prefix has to be compared
    inner = np.flatnonzero((before > 0) & (places > 0))
    head[inner] = ids[inner - 1] != ids[before[inner] - 1]
    common = np.zeros(len(ids), np.int32)
    compared = np.flatnonzero(head & (before >= 0))
    common[compared] = common_prefixes(ids, compared, before[compared])
    origin = np.maximum.accumulate(np.where(head, places, 0))
    return before, common[origin] - (places - origin)


def longest_repeats(ids: np.ndarray) -> np.ndarray:
    """For each position, the length of its longest prefix that also starts elsewhere.

    The neighbours in the suffix array decide; these lengths are the depths of the innermost
    common-prefix intervals, so the spans [i, i + length) cover all maximal repeats.
    """
    before, common = previous_prefixes(ids)
    longest = common.copy()
    has = np.flatnonzero(before >= 0)
    longest[before[has]] = np.maximum(longest[before[has]], common[has])
    return longest
