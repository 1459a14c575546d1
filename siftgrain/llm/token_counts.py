"""Operator 10: exact token counts at every prefix, by prefix dynamic programming.

The vocabulary is that of a byte-pair model. The tokens of a prefix are the
tokens of a shorter prefix and one more token, so

    last(i)  = the one piece that ends at i and may follow last(i - its length)
    count(i) = count(i - length of last(i)) + 1

and one pass gives the count of every prefix. Words (with the markers before
them) are independent, so a text's counts are sums over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.pieces import Pieces, marked, segments
from siftgrain.llm.store import small_batches
from siftgrain.llm.trie import SHORT_BYTES, WORDS, DoubleArray, char_sizes, matrix

#: Pairs of pieces that a task remembers at a time; beyond it they are checked anew.
MEMO_PAIRS = 1 << 19

#: Characters of the longest piece, so that a count never changes by more than a signed byte holds: a character adds at most its bytes, and takes at most those of a piece.
LONGEST = 30

#: Stands for no piece: the start of a word, or a character given as bytes.
NONE = -1


class PrefixCounter:
    """Counts of the prefixes of words."""

    def __init__(self, pieces: Pieces) -> None:
        own = pieces.matchable()
        self.text, self.fallback = pieces.texts, pieces.byte_fallback
        self.score = {pieces.texts[i]: float(pieces.scores[i]) for i in own}
        stands = [i for i in own if self.merge(list(pieces.texts[i])) == [pieces.texts[i]]]
        self.trie = DoubleArray([pieces.texts[i].encode() for i in stands], stands)
        self.keys = np.full(4 * MEMO_PAIRS, -1, np.int64)
        self.apart = np.zeros(4 * MEMO_PAIRS, bool)
        self.filled = 0

    def merge(self, symbols: list[str]) -> list[str]:
        """Byte-pair merges of a short list of symbols: best score first, then leftmost."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                break
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]
        return symbols

    def follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether pieces stay apart when the characters of both are merged together; NONE is followed by any."""
        out = left == NONE
        todo = np.flatnonzero(~out)
        key = left[todo].astype(np.int64) << 32 | right[todo]
        mask = len(self.keys) - 1
        slot = (K.mix(key.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
        while len(todo):
            found = self.keys[slot]
            same = found == key
            out[todo[same]] = self.apart[slot[same]]
            new = np.flatnonzero(found == -1)
            if len(new):
                first = np.unique(slot[new], return_index=True)[1]
                for k in new[first].tolist():
                    a, b = self.text[key[k] >> 32], self.text[key[k] & 0xFFFFFFFF]
                    self.keys[slot[k]] = key[k]
                    self.apart[slot[k]] = self.merge(list(a + b)) == [a, b]
                self.filled += len(first)
                continue
            slot = (slot[~same] + 1) & mask
            todo, key = todo[~same], key[~same]
        if self.filled > MEMO_PAIRS:
            self.keys.fill(-1)
            self.filled = 0
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of the prefixes (by characters) of many words, one after another, and where each word's begin."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        many = order[size[order] <= SHORT_BYTES]
        out: list[np.ndarray | None] = [None] * len(size)
        chars = np.zeros(len(size), np.int64)
        for k in order[: len(order) - len(many)].tolist():
            out[k] = self._one(data[start[k] : end[k]].tobytes())
            chars[k] = len(out[k])
        parts = []
        for k in range(0, len(many), WORDS):
            part = many[k : k + WORDS]
            words, sizes = matrix(data, start[part], end[part])
            count, ends = self._many(words, sizes)
            ends[:, 0] = False
            ends[np.arange(len(part)), sizes] = True
            chars[part] = ends.sum(1)
            parts.append((part, count[ends]))
        at = np.concatenate([[0], np.cumsum(chars)])
        flat = np.zeros(at[-1], np.int64)
        for part, own in parts:
            many_chars = chars[part]
            rank = np.arange(len(own)) - np.repeat(np.cumsum(many_chars) - many_chars, many_chars)
            flat[np.repeat(at[part], many_chars) + rank] = own
        for k, own in enumerate(out):
            if own is not None:
                flat[at[k] : at[k + 1]] = own
        return flat, at

    def _many(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts after each byte, and which bytes begin a character (rows by falling size)."""
        n, wide = words.shape
        last = np.full((n, wide + 1), NONE, np.int32)
        count = np.full((n, wide + 1), -1, np.int32)
        count[:, 0] = 0
        step = char_sizes(words, size)
        opens = np.zeros((n, wide + 1), bool)
        opens[:, :wide] = step > 0
        for s in range(wide):
            rows = np.flatnonzero(opens[: np.searchsorted(-size, -s), s])
            before = last[rows, s]
            for e, row, piece in self.trie.walk(words, size, rows, s):
                open_ = count[row, e] < 0
                row, piece = row[open_], piece[open_]
                fits = self.follows(before[np.searchsorted(rows, row)], piece)
                row = row[fits]
                last[row, e], count[row, e] = piece[fits], count[row, s] + 1
            after = s + step[rows, s].astype(np.int64)
            inside = np.minimum(after, wide)
            # a character that no piece reaches: its bytes, and nothing merges over it
            for width in (1, 2, 3, 4):
                mine = rows[(after - s == width) & (inside == after)]
                if len(mine):
                    lost = mine[self._lost(words, mine, s, width)]
                    count[lost, s + width] = count[lost, s] + (width if self.fallback else 1)
        return count, opens

    def _lost(self, words: np.ndarray, rows: np.ndarray, s: int, width: int) -> np.ndarray:
        """Whether the character at s has no piece of its own."""
        node = np.zeros(len(rows), np.int32)
        good = np.ones(len(rows), bool)
        for k in range(width):
            following = self.trie.base[node] + words[rows, s + k] + 1
            good &= self.trie.check[following] == node
            node = np.where(good, following, 0)
        return ~(good & (self.trie.value[node] >= 0))

    def _one(self, word: bytes) -> list[int]:
        """Counts of the prefixes of one word of any size."""
        text = word.decode()
        at = np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])]).tolist()
        last: dict[int, int] = {0: NONE}
        count: dict[int, int] = {0: 0}
        for s, e in zip(at, at[1:]):
            own = False
            for stop, piece in self.trie.prefixes(word, s):
                own |= stop == e
                if stop not in count and self.follows(np.array([last[s]]), np.array([piece]))[0]:
                    last[stop], count[stop] = piece, count[s] + 1
            if not own:
                last[e], count[e] = NONE, count[s] + (e - s if self.fallback else 1)
        return [count[e] for e in at[1:]]


def _schema(df: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_chars long, n_tokens long, prefix_delta binary"


def prefix_token_counts(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, n_bytes, n_chars, n_tokens and prefix_delta.

    prefix_delta holds a signed byte for each character: how much the exact
    token count of the prefix grows (or falls) by that character, so that its
    running sum is the count at every prefix (`counts_of`). The marker put
    before a text counts with its first character.

    A null or empty text has 0 tokens and an empty prefix_delta; a null id is
    kept as null; equal rows give equal rows; other columns of df, whatever
    their names, are not looked at; an empty table gives an empty table. Texts
    of any length are handled, one at a time when long. Raises ValueError for a
    vocabulary with pieces of more than LONGEST characters.
    """
    if max((len(pieces.texts[i]) for i in pieces.matchable()), default=0) > LONGEST:
        raise ValueError(f"a piece has more than {LONGEST} characters")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(shared.value)
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            for i, j in K.chunks(start, end):
                own, at = K.gather(data, start[i:j], end[i:j])
                tokens, chars, delta, delta_at = _chunk(own, at, counter, shared.value.dummy_prefix)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(chars), pa.array(tokens), _binary(delta, delta_at)],
                    names=[id_col, "n_bytes", "n_chars", "n_tokens", "prefix_delta"],
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, _schema(df, id_col))


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _chunk(data: np.ndarray, at: np.ndarray, counter: PrefixCounter, prefix: bool):
    """Tokens and characters of each text, and the deltas of all characters with where each text's begin."""
    text, text_at = marked(data, at, prefix)
    start, end, first = segments(text, text_at)
    sample, inverse = K.distinct_spans(text, start, end)
    counts, pool_at = counter.counts(text, start[sample], end[sample])
    flat = np.diff(counts, prepend=0)
    flat[pool_at[:-1]] = counts[pool_at[:-1]]
    flat = flat.astype(np.int8)
    sums = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    totals = sums[pool_at[1:]] - sums[pool_at[:-1]]
    by_text = np.concatenate([[0], np.cumsum(totals[inverse])])[first]
    deltas, delta_at = K.gather(flat.view(np.uint8), pool_at[:-1][inverse], pool_at[1:][inverse])
    text_delta = delta_at[first]
    if prefix and len(deltas):  # the marker before a text isn't one of its characters
        full = np.flatnonzero(np.diff(text_delta) > 0)
        ahead = text_delta[full]
        keep = np.ones(len(deltas), bool)
        keep[ahead] = False
        moved = deltas.view(np.int8).copy()
        moved[ahead + 1] += moved[ahead]
        deltas = moved[keep]
        text_delta = text_delta - np.searchsorted(ahead, text_delta, side="left")
    return np.diff(by_text), np.diff(text_delta), deltas, text_delta


def counts_of(prefix_delta: bytes) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(prefix_delta, np.int8), dtype=np.int64)


def fit_to_budget(counted: DataFrame, budget: int, out_col: str = "n_chars_fit") -> DataFrame:
    """Add the length in characters of the longest prefix of at most `budget` tokens; null where prefix_delta is null."""

    @F.pandas_udf("long")
    def longest(deltas: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> int | None:
            if d is None:
                return None
            fits = np.flatnonzero(counts_of(d) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        return deltas.map(one).astype("Int64")

    return counted.withColumn(out_col, longest("prefix_delta"))


def tokens_at(counted: DataFrame, n_chars: int, out_col: str = "n_tokens_at") -> DataFrame:
    """Add the exact token count of each text's first n_chars characters (all of a shorter text)."""

    @F.pandas_udf("long")
    def at(deltas: pd.Series) -> pd.Series:
        return deltas.map(lambda d: None if d is None else int(np.frombuffer(d, np.int8)[:n_chars].sum(dtype=np.int64))).astype("Int64")

    return counted.withColumn(out_col, at("prefix_delta"))


def over_budget(counted: DataFrame, budget: int) -> DataFrame:
    """Add over_limit: whether the text has more than `budget` tokens."""
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(budget))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: token counts of every document under the public 32k byte-pair pieces, against a budget of 4096 tokens.

    n_chars_fit is the length of the longest prefix within the budget, n_tokens_1000 the count of the first 1000 characters; both come from the prefix counts.
    """
    import public_tokenizers

    pieces = Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    counted = prefix_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces)
    answers = tokens_at(fit_to_budget(over_budget(counted, 4096), 4096), 1000, "n_tokens_1000")
    return answers.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars", "n_chars_fit", "n_tokens_1000")


__all__ = ["PrefixCounter", "counts_of", "fit_to_budget", "over_budget", "prefix_token_counts", "query", "tokens_at"]
