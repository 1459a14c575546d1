"""Operator 7: language identification by string kernels.

The kernel of two texts is a blended spectrum: how many distinct n-grams, of all
lengths up to `longest`, both have, over the geometric mean of how many each
has. Landmarks from the labelled rows give a Nystroem approximation of the
kernel, and one-versus-rest kernel ridge regression on it the weights. A text is
then scored by two matrix products: its n-gram presences by the landmarks'
n-gram presences, and the kernel values by the weights.

n-grams are of the bytes of words (ASCII letters lower-cased, digits and other
ASCII as breaks), hashed into a fixed space; n-grams that no landmark has count
for the norm only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.store import drop_table, small_batches, write_table

#: The label of a text without a letter.
UNKNOWN = "und"
#: Rows that the model is fitted on, and landmarks among them, at most. Rows are taken by the hash of their id, evenly from the languages.
FIT_ROWS, LANDMARKS = 2000, 96
#: Parts that a label's rows are dealt into.
SALTS = 64
#: Places that n-grams are hashed into.
SPACE = 1 << 15
#: Rows, and bytes of their texts, that one matrix product scores.
ROWS, ROW_BYTES = 128, 1 << 19
_U64 = np.uint64

#: Bytes as they count: a-z and all beyond ASCII; 0 is a break.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


@dataclass
class KernelModel:
    labels: list[str]
    columns: np.ndarray  #: places of the n-grams that landmarks have
    landmarks: np.ndarray  #: (columns, landmarks) presences over the root of each landmark's norm
    weights: np.ndarray  #: (landmarks, labels)
    bias: np.ndarray
    longest: int
    sharpness: float


def presences(data: np.ndarray, at: np.ndarray, longest: int) -> np.ndarray:
    """For each text the places that its n-grams of 1 to `longest` bytes have; n-grams don't cross breaks."""
    n = len(at) - 1
    out = np.zeros((n, SPACE), bool)
    own = _CLASS[data]
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    whole = np.ones(len(own), bool)
    code = np.zeros(len(own), np.uint32)
    for size in range(longest):
        if len(own) <= size:
            break
        m = len(own) - size
        ahead = own[size:]
        whole = whole[:m] & (ahead > 0) & (row[:m] == row[size:])
        code = code[:m] * np.uint32(257) + ahead + np.uint32(1)
        place = (code * np.uint32(2654435769)) >> np.uint32(17)
        out[row[:m][whole], place[whole]] = True
    return out


def fit(texts: list[str], labels: list[str], longest: int = 3, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> KernelModel:
    """Fit on labelled texts, on the driver."""
    raw = [t.encode() for t in texts]
    x = np.concatenate([presences(np.frombuffer(r, np.uint8), np.array([0, len(r)]), longest) for r in raw]) if raw else np.zeros((0, SPACE), bool)
    return fit_presences(x, labels, longest, landmarks, ridge)


def fit_presences(x: np.ndarray, labels: list[str], longest: int = 3, landmarks: int = LANDMARKS, ridge: float = 1e-3) -> KernelModel:
    """Fit on the presences of labelled texts (on the driver; the rows are bounded by the caller). Landmarks are dealt evenly over the labels, in order."""
    names = sorted(set(labels))
    norm = np.sqrt(np.maximum(1, x.sum(1)))
    by_label = [[i for i, label in enumerate(labels) if label == name] for name in names]
    picked = sorted(i for own in by_label for i in own[: max(1, landmarks // max(1, len(names)))])
    columns = np.flatnonzero(x[picked].any(0)) if picked else np.zeros(0, np.int64)
    marks = (x[picked][:, columns] / norm[picked][:, None]).T.astype(np.float32)
    kernel = (x[:, columns].astype(np.float32) @ marks).astype(np.float64) / norm[:, None]
    # Nystroem features: the landmarks' kernel to the power of -1/2
    value, vector = np.linalg.eigh(kernel[picked] if picked else np.zeros((0, 0)))
    good = value > 1e-8 * max(1e-12, value.max(initial=0))
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    target = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0) if names else np.zeros((0, 0))
    mean, target_mean = features.mean(0) if len(features) else np.zeros(0), target.mean(0) if len(target) else np.zeros(0)
    a = features - mean
    w = np.linalg.solve(a.T @ a + ridge * max(1, len(a)) * np.eye(a.shape[1]), a.T @ (target - target_mean)) if len(names) else np.zeros((0, 0))
    return KernelModel(names, columns, marks, root @ w, target_mean - mean @ w, longest, 4.0)


def scores(model: KernelModel, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-versus-rest scores of each text, in blocks of rows; how many places its n-grams have, and how many of these a landmark has."""
    n = len(at) - 1
    out, places, known = np.zeros((n, len(model.labels))), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, j in K.chunks(at[:-1], at[1:], ROW_BYTES):
        for k in range(i, j, ROWS):
            stop = min(k + ROWS, j)
            x = presences(data[at[k] : at[stop]], at[k : stop + 1] - at[k], model.longest)
            places[k:stop] = x.sum(1)
            x = x[:, model.columns]
            known[k:stop] = x.sum(1)
            kernel = x.astype(np.float32) @ model.landmarks
            out[k:stop] = (kernel / np.sqrt(np.maximum(1, places[k:stop]))[:, None]) @ model.weights + model.bias
    return out, places, known


def sample(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = FIT_ROWS, longest: int = 3) -> tuple[np.ndarray, list[str]]:
    """Presences and labels of at most `rows` labelled rows that have letters, taken by the hash of their id, evenly from the labels.

    A label's rows are dealt into SALTS parts, so that no task gets all of them;
    the rows with the least hashes of each part come first. df is read twice:
    for the hashes, and for the rows taken. What the driver gets of a row is
    SPACE bits, however long its text is.
    """
    spark = df.sparkSession
    own = df.filter(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(label_col).cast("string").alias("label"), F.struct(F.xxhash64(id_col).alias("h"), F.xxhash64(text_col).alias("t")).alias("h"), F.col(text_col).alias("text")
    )

    def least(frame: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
        return frame.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)

    salted = own.select("label", "h", F.pmod(F.col("h.t"), F.lit(SALTS)).alias("salt"))
    candidates, path = write_table(least(salted, ["label", "salt"], ["h"], -(-rows // SALTS)).withColumnRenamed("rank", "place"), "language-rows")
    names = candidates.groupBy("label").count().orderBy(F.desc("count"), "label").limit(rows)
    each = max(1, rows // max(1, names.count()))
    picked = least(candidates.join(F.broadcast(names.select("label")), "label"), ["label"], ["place", "h"], each).select(F.col("label").alias("its_label"), F.col("h").alias("its_h")).distinct()
    found = own.join(F.broadcast(picked), (F.col("label") == F.col("its_label")) & (F.col("h") == F.col("its_h"))).select("label", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(2))
            for i, j in K.chunks(start, end, ROW_BYTES):
                for k in range(i, j, ROWS):
                    stop = min(k + ROWS, j)
                    bits = np.packbits(presences(*K.gather(data, start[k:stop], end[k:stop]), longest), axis=1)
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, stop - k) for c in batch.columns[:2]), pa.array([b.tobytes() for b in bits], pa.binary())], names=["label", "h", "bits"])

    rows_ = found.mapInArrow(run, "label string, h struct<h: long, t: long>, bits binary").dropDuplicates(["label", "h"])
    held = sorted(((r.label, r.h.h, r.h.t, r.bits) for r in rows_.collect()), key=lambda r: r[:3])
    drop_table(spark, path)
    x = np.unpackbits(np.frombuffer(b"".join(r[3] for r in held), np.uint8).reshape(len(held), -1), axis=1).astype(bool) if held else np.zeros((0, SPACE), bool)
    return x, [r[0] for r in held]


def predict(df: DataFrame, model: KernelModel, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of df: id, lang_pred string, score double (0 to 1), n_grams long, n_known long, and with keep_text the text.

    n_grams counts the places of the text's n-grams, n_known those of them that
    a landmark has. The score is the softmax of the one-versus-rest scores. A text that is null
    or has no letter is `und` with score 1; so is every text, with score 0, of a
    model without labels. Ties go to the label that sorts first. Repeated rows
    and rows with a null id are predicted like any other; other columns are not
    looked at; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.labels, UNKNOWN], object)
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            for i, j in K.chunks(start, end):
                raw, at = K.gather(data, start[i:j], end[i:j])
                best, score = np.full(j - i, len(own.labels)), np.where(letters[i:j], 0.0, 1.0)
                places = known = np.zeros(j - i, np.int64)
                if own.labels:
                    s, places, known = scores(own, raw, at)
                    s = s * own.sharpness
                    s = np.exp(s - s.max(1, keepdims=True))
                    best = np.where(letters[i:j], s.argmax(1), best)
                    score = np.where(letters[i:j], s.max(1) / s.sum(1), 1.0)
                columns = [batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score), pa.array(places), pa.array(known), *([batch.column(1).slice(i, j - i)] if keep_text else [])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "n_grams", "n_known", *([text_col] if keep_text else [])])

    kind = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_grams long, n_known long" + f", `{text_col}` string" * keep_text
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.select(F.col(id_col), F.col(text_col), letter).mapInArrow(run, kind)


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learned(docs: DataFrame) -> KernelModel:
    """The model of the documents that aren't held out."""
    return fit_presences(*sample(docs.filter(~held_out("doc_id")), "doc_id", "text", "lang"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learned(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
