"""Vectorised byte and word kernels over the text buffers of Arrow batches.

All kernels work on the UTF-8 bytes of whole texts. A null text has no bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

pa.set_memory_pool(pa.system_memory_pool())


def settle() -> None:
    """Give freed memory back to the system; workers live for many tasks, and a heap that only grows is held for all of them."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of text that one kernel call handles; a longer document is a call of its own.
CHUNK_BYTES = 1 << 20

_U64 = np.uint64
#: Bytes of a string up to which it is hashed and compared in vectors, 8 bytes at a time; longer ones go one by one.
LONG = 128
# Fixed odd constants of the hash.
_STEP, _SIZE = _U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], _U64)

#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (of lower-cased text).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser (splitmix64) that spreads all bits of 64-bit values."""
    h = h ^ (h >> _U64(30))
    h *= _U64(0xBF58476D1CE4E5B9)
    h ^= h >> _U64(27)
    h *= _U64(0x94D049BB133111EB)
    h ^= h >> _U64(31)
    return h


def _windows(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number; beyond the end stand zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings [start, end), equal wherever a string stands.

    Each 8 bytes go through a finaliser that isn't linear, so that no pattern of
    bytes makes strings collide; by chance two do so once in 2**64. Where a
    result follows from equality, `distinct_spans` or `differ` compares bytes.
    """
    size = end - start
    look = _windows(data)
    h = mix(_SIZE * (size.astype(_U64) + _U64(1)))
    own = np.flatnonzero((size > 0) & (size <= LONG))
    for k in range(0, LONG, 8):
        if k:
            own = own[size[own] > k]
        if not len(own):
            break
        part = look[start[own] + k] & _MASKS[np.minimum(size[own] - k, 8)]
        h[own] = mix(h[own] * _STEP + part) ^ (part + (h[own] >> _U64(32)))
    h = mix(h)
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = int.from_bytes(blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return h


def rolling_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the byte strings of one size that begin at each place."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, _U64)
    look, h = _windows(data), np.zeros(n, _U64)
    for k in [*range(0, size - 7, 8), *([max(0, size - 8)] if size % 8 else [])]:
        if k:  # nothing of 0 to mix
            h ^= h >> _U64(32)
            h *= _STEP
        h += look[k : k + n] & _MASKS[min(8, size)]
    return mix(h)


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether the `size` bytes from places a on and those from places b on, of other bytes if there are any, differ."""
    look = _windows(data)
    same = (a == b) if other is None else np.zeros(len(a), bool)
    beside, other = (look, data) if other is None else (_windows(other), other)
    out = np.zeros(len(a), bool)
    own = np.flatnonzero((size <= LONG) & ~same)
    for k in range(0, LONG, 8):
        own = own[size[own] > k]
        if not len(own):
            break
        out[own] |= ((look[a[own] + k] ^ beside[b[own] + k]) & _MASKS[np.minimum(size[own] - k, 8)]) != 0
    for k in np.flatnonzero((size > LONG) & ~same).tolist():
        out[k] = not np.array_equal(data[a[k] : a[k] + size[k]], other[b[k] : b[k] + size[k]])
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sample, inverse): one span of each distinct byte string, and which of them each span's string is. Exact: hashes find, bytes decide."""
    _, sample, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    size = end - start
    wrong = size != size[sample][inverse]
    wrong |= differ(data, start, start[sample][inverse], np.where(wrong, 0, size))
    if wrong.any():
        known: dict[bytes, int] = {}
        first = []
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            place = known.setdefault(data[a:b].tobytes(), len(first))
            if place == len(first):
                first.append(k)
            inverse[k] = place
        sample = np.array(first, np.int64)
    return sample, inverse


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and each row's start and end; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    if n == 0 or offsets is None:
        none = np.zeros(n, np.int64)
        return np.zeros(0, np.uint8), none, none.copy()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    start, end = at[:-1].copy(), at[1:].copy()
    if column.null_count:
        end = np.where(column.is_null().to_numpy(zero_copy_only=False), start, end)
    return data, start, end


def chunks(start: np.ndarray, end: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, or one row."""
    settle()
    i, n = 0, len(start)
    total = np.concatenate([[0], np.cumsum(end - start)])
    while i < n:
        j = int(np.searchsorted(total, total[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
    settle()


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes one after another, and where each begins (with the end of the last)."""
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    if len(start) and (start[1:] == end[:-1]).all():
        return data[start[0] : end[-1]], at
    return data[np.repeat(start - at[:-1], end - start) + np.arange(at[-1])], at


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of the texts that lie at data[at[i]:at[i+1]], and `first`: text i has words first[i]:first[i+1]."""
    inside = is_word[data]
    opens, closes = inside.copy(), inside.copy()
    edges = at[(at > 0) & (at < len(data))]
    if len(data):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        opens[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of lower-cased texts, and each text's first word."""
    data = LOWER[data]
    start, end, first = word_spans(data, at, is_word)
    return span_hash(data, start, end), start, end, first


def sequence_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n successive values, in order."""
    if len(h) < n:
        return np.zeros(0, _U64)
    out = np.zeros(len(h) - n + 1, _U64)
    for i in range(n):
        out = out * _U64(0xD6E8FEB86659FD93) + h[i : len(h) - n + 1 + i]
    return mix(out)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column of `counts` values for each row."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
