"""Enhanced suffix arrays in numpy over many short texts at once, and the stack scan of their common-prefix intervals."""

from __future__ import annotations

import numpy as np


def dense_ranks(keys: np.ndarray) -> np.ndarray:
    """For each key the number of smaller keys: equal keys share a rank, which is their first place in sorted order."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
    return ranks


def suffix_array(first: np.ndarray, room: np.ndarray, width: int = 1, cap: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix lengths by prefix doubling.

    first: dense rank of the first `width` symbols at each position; room: symbols from there to the end of its text;
    cap: longest prefix to compare. lcp[k] belongs to entries k - 1 and k of the array, in multiples of width, lcp[0] is
    0. Positions that are already alone in their class drop out of later rounds.
    """
    n = len(first)
    levels, now, w = [(width, first)], first, width
    counts = np.bincount(now, minlength=n) if n else np.zeros(0, np.int64)
    active = np.flatnonzero(counts[now] > 1) if n else np.zeros(0, np.int64)
    while len(active) and w < cap:
        ahead = np.zeros(len(active), np.int64)
        inside = room[active] > w
        ahead[inside] = now[active[inside] + w] + 1
        order = np.argsort(now[active] << 31 | ahead)
        at, old, nxt = active[order], now[active][order], ahead[order]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        sub = group | np.concatenate(([True], nxt[1:] != nxt[:-1]))
        k = np.arange(len(at))
        start = np.maximum.accumulate(np.where(group, k, 0))
        mine = np.maximum.accumulate(np.where(sub, k, 0))
        now = now.copy()
        now[at] = old + (mine - start)
        size = np.diff(np.append(np.flatnonzero(sub), len(at)))
        active = at[np.repeat(size, size) > 1]
        w *= 2
        levels.append((w, now))
    order = np.argsort(now)
    lcp = np.zeros(n, np.int64)
    a, b, k = order[:-1].copy(), order[1:].copy(), np.arange(1, n)
    for w, ranks in reversed(levels):
        same = ranks[np.minimum(a, n - 1)] == ranks[np.minimum(b, n - 1)]
        same &= (room[np.minimum(a, n - 1)] - 0 >= w) & (room[np.minimum(b, n - 1)] >= w) & (a < n) & (b < n)
        same &= (lcp[k] < room[order[:-1]]) & (lcp[k] < room[order[1:]])
        lcp[k[same]] += w
        a[same] += w
        b[same] += w
    return order, lcp


def lcp_intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All common-prefix intervals (first entry, last entry, length) with length >= least, inner ones first.

    One pass with a stack over the entries whose lcp reaches least; the intervals form a tree by inclusion.
    """
    found: list[tuple[int, int, int]] = []
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return found
    values = lcp[high].tolist()
    stack: list[tuple[int, int]] = []  # (length, first entry)
    last = -2
    for k, value in zip(high.tolist(), values, strict=True):
        if k != last + 1:
            while stack:
                length, left = stack.pop()
                found.append((left, last, length))
        left = k - 1
        while stack and stack[-1][0] > value:
            length, left = stack.pop()
            found.append((left, k - 1, length))
        if not stack or stack[-1][0] < value:
            stack.append((value, left))
        last = k
    while stack:
        length, left = stack.pop()
        found.append((left, last, length))
    return found
