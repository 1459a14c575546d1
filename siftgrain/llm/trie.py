"""A double-array trie over byte strings, walked for many words at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Longer words are handled one by one.
SHORT_BYTES = 48

#: Words that a lattice holds at a time.
WORDS = 1 << 15


class DoubleArray:
    """base, check and value arrays: the child of node s by byte b is t = base[s] + b + 1 if check[t] == s."""

    def __init__(self, keys: list[bytes], values: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        held = [-1]
        for key, value in zip(keys, values, strict=True):
            node = 0
            for b in key:
                following = children[node].get(b + 1)
                if following is None:
                    following = children[node][b + 1] = len(children)
                    children.append({})
                    held.append(-1)
                node = following
            held[node] = value
        size = 2 * len(children) + 4096
        taken = bytearray(size)
        taken[0] = 1
        cell, base_of = [0] * len(children), [0] * len(children)
        low = 1
        # nodes with many children first, so that the rest fill the gaps
        for node in sorted(range(len(children)), key=lambda n: -len(children[n])):
            codes = sorted(children[node])
            if not codes:
                break
            if len(codes) == 1:
                base = taken.index(0, max(low, codes[0])) - codes[0]
            else:
                place, misses = max(low, codes[0]), 0
                while True:
                    place = taken.index(0, place)
                    base = place - codes[0]
                    if not any(taken[base + c] for c in codes):
                        break
                    place, misses = place + 1, misses + 1
                if misses > 64:  # the cells below are nearly full
                    low += misses // 2
            base_of[node] = base
            for c in codes:
                taken[base + c] = 1
                cell[children[node][c]] = base + c
            if base + 600 > len(taken) - 300:
                taken.extend(bytes(len(taken)))
        self.base = np.zeros(len(taken), np.int32)
        self.check = np.full(len(taken), -1, np.int32)
        self.value = np.full(len(taken), -1, np.int32)
        self.check[0] = -2
        for node, below in enumerate(children):
            self.base[cell[node]], self.value[cell[node]] = base_of[node], held[node]
            for following in below.values():
                self.check[cell[following]] = cell[node]

    def prefixes(self, word: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of each key that stands at word[start:end]."""
        base, check, node = self.base, self.check, 0
        for i in range(start, len(word)):
            following = base[node] + word[i] + 1
            if check[following] != node:
                return
            node = following
            if self.value[node] >= 0:
                yield i + 1, int(self.value[node])

    def walk(self, words: np.ndarray, size: np.ndarray, rows: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As prefixes, for many rows of a matrix of bytes: (end, rows, values), by growing end."""
        node, end = np.zeros(len(rows), np.int32), start
        while len(rows):
            if end >= words.shape[1]:
                return
            following = self.base[node] + words[rows, end] + 1
            found = (self.check[following] == node) & (size[rows] > end)
            rows, node, end = rows[found], following[found], end + 1
            value = self.value[node]
            held = value >= 0
            if held.any():
                yield end, rows[held], value[held]


def matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of a matrix of int32 bytes (0 after a word's end), and their sizes."""
    size = end - start
    wide = int(size.max()) if len(size) else 0
    columns = np.arange(wide)
    inside = columns < size[:, None]
    at = np.where(inside, start[:, None] + columns, 0)
    return np.where(inside, data[at], 0).astype(np.int32), size


def char_sizes(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each byte the size of the character that begins there; 0 inside one and after the end."""
    out = np.ones(words.shape, np.int8)
    out[words >= 0xC0] = 2
    out[words >= 0xE0] = 3
    out[words >= 0xF0] = 4
    out[(words >= 0x80) & (words < 0xC0)] = 0
    out[np.arange(words.shape[1]) >= size[:, None]] = 0
    return out
