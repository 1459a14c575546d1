"""Operator 1: SentencePiece encoding and decoding.

A text becomes marked text (each space is the marker U+2581, and one marker
stands ahead). The best segmentation into pieces, by the sum of the pieces' log
scores, is found by Viterbi over a double-array trie (unigram segmentation).
Characters without a piece become byte pieces, or the unknown piece where the
vocabulary has no bytes. Decoding concatenates the pieces, reads byte pieces as
UTF-8, turns markers into spaces and drops the one ahead.

The pieces and their scores come from a public vocabulary file; none is trained.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.pieces import BYTE, CONTROL, MARK, NORMAL, UNKNOWN, Pieces, marked, segments
from siftgrain.llm.store import small_batches
from siftgrain.llm.trie import SHORT_BYTES, WORDS, DoubleArray, char_sizes, matrix

#: What an unknown character scores below the least score of a piece.
UNKNOWN_PENALTY = 10.0


class Viterbi:
    """Best segmentations of words. Of equal ones the one whose last differing piece begins first."""

    def __init__(self, pieces: Pieces) -> None:
        own = pieces.matchable()
        self.trie = DoubleArray([pieces.texts[i].encode() for i in own], own)
        self.scores = pieces.scores.astype(np.float64)
        normal = self.scores[pieces.kinds == NORMAL]
        self.unknown_score = (normal.min() if len(normal) else 0.0) - UNKNOWN_PENALTY
        self.unknown_id = pieces.unknown_id
        self.byte_ids = pieces.byte_ids if pieces.byte_fallback else None

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words one after another, where each word's begin, and each word's score."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        many = order[size[order] <= SHORT_BYTES]
        score = np.zeros(len(size))
        row_parts, id_parts = [], []
        for k in order[: len(order) - len(many)].tolist():
            ids, score[k] = self._one(data[start[k] : end[k]].tobytes())
            row_parts.append(np.full(len(ids), k))
            id_parts.append(np.array(ids, np.int32))
        for k in range(0, len(many), WORDS):
            part = many[k : k + WORDS]
            rows, ids, score[part] = self._many(*matrix(data, start[part], end[part]))
            row_parts.append(part[rows])
            id_parts.append(ids)
        row = np.concatenate(row_parts or [np.zeros(0, np.int64)])
        ids = np.concatenate(id_parts or [np.zeros(0, np.int32)])
        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
        return ids[np.argsort(row, kind="stable")], at, score

    def _many(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and ids, each row's in order, and the rows' scores (rows by falling size)."""
        n, wide = words.shape
        best = np.full((n, wide + 1), -np.inf)
        best[:, 0] = 0
        origin = np.zeros((n, wide + 1), np.int16)
        piece = np.full((n, wide + 1), -1, np.int32)
        step = char_sizes(words, size)
        for s in range(wide):
            rows = np.flatnonzero(step[: np.searchsorted(-size, -s), s] > 0)
            rows = rows[best[rows, s] > -np.inf]
            width = step[rows, s].astype(np.int64)
            alone = np.zeros(n, bool)
            for e, row, own in self.trie.walk(words, size, rows, s):
                total = best[row, s] + self.scores[own]
                better = total > best[row, e]
                alone[row[step[row, s] == e - s]] = True
                row = row[better]
                best[row, e], origin[row, e], piece[row, e] = total[better], s, own[better]
            lost = ~alone[rows]
            row, e = rows[lost], s + width[lost]
            total = best[row, s] + self.unknown_score
            better = total > best[row, e]
            row, e = row[better], e[better]
            best[row, e], origin[row, e], piece[row, e] = total[better], s, -1
        rows, at = np.arange(n), size.astype(np.int64)
        parts = []
        while len(rows):
            back = origin[rows, at].astype(np.int64)
            parts.append((rows, back, at, piece[rows, at]))
            rows, at = rows[back > 0], back[back > 0]
        row, back, end, own = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((back, row))
        row, back, end, own = row[order], back[order], end[order], own[order]
        own, repeat = self._expand(own, end - back, lambda k: words[row[k], back[k] : end[k]])
        return np.repeat(row, repeat), own, best[np.arange(n), size]

    def _expand(self, own: np.ndarray, width: np.ndarray, raw) -> tuple[np.ndarray, np.ndarray]:
        """Ids with byte ids for unknown characters, and how many each became."""
        repeat = np.ones(len(own), np.int64)
        lost = np.flatnonzero(own < 0)
        if self.byte_ids is not None:
            repeat[lost] = width[lost]
        out = np.repeat(own, repeat)
        first = np.cumsum(repeat) - repeat
        for k in lost.tolist():
            out[first[k] : first[k] + repeat[k]] = self.unknown_id if self.byte_ids is None else self.byte_ids[raw(k)]
        return out, repeat

    def _one(self, word: bytes) -> tuple[list[int], float]:
        """Ids and score of one word of any size."""
        text = word.decode()
        ends = np.cumsum([len(c.encode()) for c in text]).tolist()
        best, origin, piece = {0: 0.0}, {}, {}
        for s, char_end in zip([0, *ends], ends, strict=False):
            alone = False
            for e, own in self.trie.prefixes(word, s):
                alone |= e == char_end
                total = best[s] + self.scores[own]
                if total > best.get(e, -np.inf):
                    best[e], origin[e], piece[e] = total, s, own
            if not alone and best[s] + self.unknown_score > best.get(char_end, -np.inf):
                best[char_end], origin[char_end], piece[char_end] = best[s] + self.unknown_score, s, -1
        out: list[int] = []
        e = len(word)
        while e:
            s = origin[e]
            if piece[e] >= 0:
                out.append(piece[e])
            elif self.byte_ids is None:
                out.append(self.unknown_id)
            else:
                out += self.byte_ids[np.frombuffer(word[s:e], np.uint8)].tolist()[::-1]
            e = s
        return out[::-1], float(best[len(word)])


class Decoder:
    """What each id stands for, one after another."""

    def __init__(self, pieces: Pieces) -> None:
        own = [b"" for _ in pieces.texts]
        for i, (text, kind) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
            if kind == BYTE:
                own[i] = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                own[i] = " ⁇ ".encode()
            elif kind != CONTROL:
                own[i] = text.replace(MARK, " ").encode()
        self.n, self.prefix = len(own), pieces.dummy_prefix
        self.pool = np.frombuffer(b"".join(own), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in own] + [0])])

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of rows of ids at ids[at[i]:at[i + 1]]."""
        ids = np.where((ids >= 0) & (ids < self.n), ids, self.n).astype(np.int64)
        flat, flat_at = K.gather(self.pool, self.at[:-1][ids], self.at[1:][ids])
        at = flat_at[at]
        drop = (np.diff(at) > 0) & self.prefix
        drop[drop] = flat[at[:-1][drop]] == 0x20
        return _strings(*K.gather(flat, at[:-1] + drop, at[1:]))


def encode(df: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each row of df: id, n_bytes long, ids array<int> and score double (sum of log scores).

    decoded: with the text that the ids decode to, as `decode` gives it, made in the same pass.

    A null or empty text has no ids and score 0; a null id is kept; repeated
    rows stay; other columns, whatever their names, are not looked at; an empty
    table gives an empty table. Whole texts are encoded, whatever their length.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, ids array<int>, score double" + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        viterbi, decoder = Viterbi(own), Decoder(own) if decoded else None
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            for i, j in K.chunks(start, end):
                raw, at = K.gather(data, start[i:j], end[i:j])
                text, text_at = marked(raw, at, own.dummy_prefix)
                a, b, first = segments(text, text_at)
                sample, inverse = K.distinct_spans(text, a, b)
                ids, ids_at, score = viterbi.encode(text, a[sample], b[sample])
                flat, flat_at = K.gather(ids, ids_at[:-1][inverse], ids_at[1:][inverse])
                total = np.concatenate([[0.0], np.cumsum(score[inverse])])[first] if len(score) else np.zeros(len(first))
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), K.lists(flat, np.diff(flat_at[first]), pa.int32()), pa.array(np.diff(total))]
                names = [id_col, "n_bytes", "ids", "score"]
                if decoder is not None:
                    columns.append(decoder.decode(flat, flat_at[first]))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(df: DataFrame, pieces: Pieces, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the decoded text of an array<int> column.

    Control pieces and ids outside the vocabulary give nothing, the unknown
    piece U+2047 between spaces, and bytes that aren't UTF-8 U+FFFD. Null ids
    give a null text, an empty array an empty text. df must have no column
    named out_col.
    """
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(pieces)
    position = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for whole in batches:
            lists = whole.column(position)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            for i, j in K.chunks(offsets[:-1], offsets[1:]):
                batch = whole.slice(i, j - i)
                ids = lists.values.slice(offsets[i], offsets[j] - offsets[i]).to_numpy(zero_copy_only=False)
                text = decoder.decode(ids, offsets[i : j + 1] - offsets[i])
                own = batch.column(position)
                if own.null_count:
                    text = pa.compute.if_else(own.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*whole.schema.names, out_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]))


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    try:
        raw.decode()
        out = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
        out.validate(full=True)
        return out
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: encode every document with the public 32k pieces and decode it again.

    ids_sha256 is the digest of the ids, comma-joined; round_trip says whether
    the decoded text has the bytes of the input.
    """
    import public_tokenizers

    pieces = Pieces.read(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode(with_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")), pieces, "key", decoded=True)
    ids = F.col("ids")
    return encoded.select(
        "key.doc_id",
        "n_bytes",
        F.size("ids").cast("long").alias("n_tokens"),
        "score",
        F.sha2(F.concat_ws(",", ids.cast("array<string>")), 256).alias("ids_sha256"),
        (F.xxhash64("decoded") == F.col("key.digest")).alias("round_trip"),
    )


def with_digest(docs: DataFrame) -> DataFrame:
    """(key struct<doc_id, digest of the text>, text): so that a decoded text can be held against its input."""
    return docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")).alias("key"), "text")


__all__ = ["Decoder", "Viterbi", "decode", "encode", "query", "with_digest"]
