"""An enhanced suffix array in numpy, and its maximal repeats by a scan of common-prefix intervals."""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffixes of the values in order of their first `depth` (rounded up to 8 times a power of 2) values, and ranks by growing depth.

    Values are 0 to 2**16 - 1; what follows the end counts as smaller than any. Ranks are (depth, rank of each
    suffix among all by that depth), which give common prefixes without the text.
    """
    n = len(data)
    levels: list[tuple[int, np.ndarray]] = []
    wide = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    rank = np.unique(wide[: n + 0], return_inverse=True)[1].astype(np.int64) + 1 if n else np.zeros(0, np.int64)
    levels.append((1, rank))
    size = 1
    while size < depth and n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - size] = rank[size:] if size < n else 0
        key = rank * np.int64(n + 2) + ahead
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        size *= 2
        levels.append((size, rank))
    return np.argsort(rank, kind="stable"), levels


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """lcp[i]: values that the suffixes order[i - 1] and order[i] have in common (to twice the greatest depth at most); lcp[0] is 0."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(n - 1, np.int64)
    for size, rank in reversed(levels):
        inside = np.maximum(a, b) + got < n
        x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
        same = inside & (rank[x] == rank[y]) & (np.maximum(a, b) + got + size <= n)
        got[same] += size
    out[1:] = got
    return out


def prefix_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the tree of common-prefix intervals with a length of `least` or more: (first, last, length).

    A scan with a stack: a value below the top closes the top's interval.
    """
    first, last, length = [], [], []
    places = np.flatnonzero(lcp >= least)
    if len(places):
        values = lcp[places].tolist()
        stack: list[tuple[int, int]] = []  # (where the interval begins, its length)
        before = -2
        for at, value in zip(places.tolist(), values, strict=True):
            if at != before + 1:
                for begin, size in reversed(stack):
                    first.append(begin)
                    last.append(before)
                    length.append(size)
                stack.clear()
            begin = at - 1
            while stack and stack[-1][1] > value:
                begin, size = stack.pop()
                first.append(begin)
                last.append(at - 1)
                length.append(size)
            if not stack or stack[-1][1] < value:
                stack.append((begin, value))
            before = at
        for begin, size in reversed(stack):
            first.append(begin)
            last.append(before)
            length.append(size)
    return np.array(first, np.int64), np.array(last, np.int64), np.array(length, np.int64)


def maximal_repeats(data: np.ndarray, least: int, depth: int, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of `least` values or more that no value ahead of or behind all occurrences extends.

    edge: places with nothing ahead, which differ from any other place to their left. Returns the
    suffixes in order, and for each repeat the range [first, last] of its occurrences in it and its length.
    """
    order, levels = suffix_array(data, depth)
    lcp = common_prefixes(order, levels)
    first, last, length = prefix_intervals(lcp, least)
    left = np.where(edge[order], -1 - order, np.concatenate([[0], data[:-1].astype(np.int64)])[order] if len(data) else order)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])]) if len(order) else np.zeros(0, np.int64)
    diverse = change[last] > change[first] if len(first) else np.zeros(0, bool)
    return order, first[diverse], last[diverse], length[diverse]
