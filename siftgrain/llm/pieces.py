"""A piece vocabulary read from a public tokenizer file, and how its texts are prepared and cut."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: The whitespace marker, U+2581.
MARK = "▁"
MARK_BYTES = MARK.encode()

NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message; a value is an int or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[i : i + n]
            i += n


@dataclass
class Pieces:
    """The pieces of a model file with log scores.

    texts[i], scores[i] and kinds[i] describe piece i; byte_ids[b] is the id of
    the piece for byte b (-1 without byte fallback).
    """

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    dummy_prefix: bool = True
    byte_fallback: bool = True
    unknown_id: int = 0
    byte_ids: np.ndarray = field(default_factory=lambda: np.full(256, -1, np.int32))

    @classmethod
    def read(cls, path: str) -> Pieces:
        """Read a model file on the driver. Only an identity normaliser is supported; others raise ValueError."""
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, raw: bytes) -> Pieces:
        texts, scores, kinds, prefix, fallback = [], [], [], True, False
        for number, value in _fields(raw):
            if number == 1:
                part = dict(_fields(value))
                texts.append(part.get(1, b"").decode())
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, NORMAL))
            elif number == 2:
                fallback = bool(dict(_fields(value)).get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that neither normalise nor drop white space are supported")
                prefix = bool(spec.get(3, 1))
        out = cls(texts, np.array(scores), np.array(kinds), prefix, fallback)
        if UNKNOWN in kinds:
            out.unknown_id = kinds.index(UNKNOWN)
        for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
            if kind == BYTE:
                out.byte_ids[int(text[3:5], 16)] = i
        if any(MARK in t.lstrip(MARK) for t, k in zip(texts, kinds, strict=True) if k in (NORMAL, USER)):
            raise ValueError("a piece spans words")
        return out

    def matchable(self) -> list[int]:
        """Ids of the pieces that text can match."""
        return [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER) and self.texts[i]]


def marked(data: np.ndarray, at: np.ndarray, dummy_prefix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts with every space as the marker, and one more marker before each text that isn't empty."""
    n = len(at) - 1
    size = np.diff(at)
    wide = np.ones(len(data), np.int64)
    wide[data == 0x20] = 3
    ahead = np.where((size > 0) & dummy_prefix, 3, 0)
    ends = np.cumsum(wide) if len(data) else np.zeros(0, np.int64)
    own = np.concatenate([[0], ends])[at]
    out_at = own + np.concatenate([[0], np.cumsum(ahead)])
    out = np.empty(out_at[-1], np.uint8)
    if len(data):
        shift = np.repeat(np.cumsum(ahead), size)
        first = ends - wide + shift
        out[first] = data
        spaces = first[data == 0x20]
        for k, b in enumerate(MARK_BYTES):
            out[spaces + k] = b
            out[out_at[:-1][ahead > 0] + k] = b
    assert n == len(out_at) - 1
    return out, out_at


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the segments of marked texts, and each text's first segment.

    A segment is a run of markers with what follows up to the next marker. No
    piece spans two segments, so each can be encoded alone.
    """
    mark = np.zeros(len(data), bool)
    if len(data) >= 3:
        mark[:-2] = (data[:-2] == MARK_BYTES[0]) & (data[1:-1] == MARK_BYTES[1]) & (data[2:] == MARK_BYTES[2])
    begins = mark.copy()
    begins[3:] &= ~mark[:-3]
    begins[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(data)) if len(start) else start
    return start, end, np.searchsorted(start, at)
