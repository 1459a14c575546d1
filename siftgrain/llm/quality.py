"""Operator 9: a quality classifier by Bradley-Terry pairwise ranking.

Each document has a strength, a weighted sum of features of its text; of two
documents the one is preferred with the logistic probability of the difference
of strengths. The weights are learned from preference pairs, a good document and
a bad one, by logistic loss on feature differences: all pairs of all labelled
documents. The threshold is the quantile of these documents' strengths at the
share of bad ones among the labels.

The sums over all pairs come from one pass over the documents: a smooth function
of strengths is, up to rounding, its values at a cell's Chebyshev nodes, so the
documents' weights and features are summed up by node, and nodes meet in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.store import drop_table, likely_ids, small_batches, write_table

#: Nodes of a cell of strengths, which is 1 wide: the logistic function is interpolated to about 1e-13.
NODES = 12
#: Newton's steps at most, and the largest change of a weight of the last one.
STEPS, CLOSE = 60, 1e-8
#: Bins of a pass that looks for the threshold.
BINS = 4096
#: The score at the threshold.
CUT = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[[0x2E, 0x3F]] = True
_COMMA = np.zeros(256, bool)
_COMMA[[0x2C, 0x3B, 0x3A]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in '!#$%&*+/<=>@[]^_`{|}~"\\']] = True
#: Classes of bytes whose share of the text is a feature.
CLASSES = {"upper": _UPPER, "lower": _LOWER, "digit": _DIGIT, "end": _END, "comma": _COMMA, "mark": _MARK, "beyond": np.arange(256) >= 0xC3, "line": np.arange(256) == 10}
FEATURES = [*CLASSES, "marked_words", "upper_words", "log_words", "word_bytes", "distinct_words", "distinct_pairs", "top_word", "repeats", "distinct_lines", "empty"]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of features for each text; all 0 but the last for an empty one."""
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    size = np.maximum(1, np.diff(at))
    for k, own in enumerate(CLASSES.values()):
        out[:, k] = np.diff(np.concatenate([[0], np.cumsum(own[data])])[at]) / size
    h, start, end, first = K.word_hashes(data, at, K.NOT_SPACE)
    words = np.diff(first)
    some = np.maximum(1, words)
    marks = np.concatenate([[0], np.cumsum(_MARK[data])])
    lower = np.concatenate([[0], np.cumsum(_LOWER[data])])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    k = len(CLASSES)
    marked = np.concatenate([[0], np.cumsum(marks[end] > marks[start])])
    shouted = np.concatenate([[0], np.cumsum((lower[end] == lower[start]) & (upper[end] > upper[start] + 1))])
    out[:, k] = np.diff(marked[first]) / some
    out[:, k + 1] = np.diff(shouted[first]) / some
    out[:, k + 2] = np.log1p(words)
    out[:, k + 3] = np.minimum(40, np.diff(np.concatenate([[0], np.cumsum(end - start)])[first]) / some)
    lines, _, _, first_line = K.word_hashes(data, at, np.arange(256) != 10)
    pairs = K.sequence_hash(h, 2)
    for i in np.flatnonzero(words).tolist():
        a, b = first[i], first[i + 1]
        counts = np.unique(h[a:b], return_counts=True)[1]
        out[i, k + 4] = len(counts) / (b - a) ** 0.9
        out[i, k + 5] = len(np.unique(pairs[a : b - 1])) / (b - a - 1) if b - a > 1 else 1.0
        out[i, k + 6] = counts.max() / (b - a)
        out[i, k + 7] = (h[a + 1 : b] == h[a : b - 1]).mean() if b - a > 1 else 0.0
        own = lines[first_line[i] : first_line[i + 1]]
        out[i, k + 8] = len(np.unique(own)) / max(1, len(own))
    out[:, k + 9] = words == 0
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    spread: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return _standard(x, self.mean, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Strengths on a logistic scale from 0 to 1 that has CUT at the threshold."""
        z = (self.strengths(x) - self.threshold) / self.spread + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _nodes() -> np.ndarray:
    """Chebyshev nodes of a cell around 0."""
    return np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES)) / 2


def _shares(t: np.ndarray) -> np.ndarray:
    """What the nodes have of a value at t within a cell: a row for each t."""
    k = np.arange(NODES)
    to = np.cos(np.outer(k, np.arccos(np.clip(2 * _nodes(), -1, 1)))) * np.where(k, 2, 1)[:, None] / NODES
    return np.cos(np.arccos(np.clip(2 * t, -1, 1))[:, None] * k) @ to


#: Sums by (cell, label).
Sums = dict[tuple[int, int], np.ndarray]


def _by_cell(z: np.ndarray, label: np.ndarray, w: np.ndarray) -> Sums:
    """For each cell of strengths and label: by node the documents and the sums of their features, and the features' products."""
    out: Sums = {}
    strength = z @ w
    cell = np.rint(strength).astype(np.int64)
    share = _shares(strength - cell)
    for c in np.unique(cell).tolist():
        for value in (0, 1):
            own = np.flatnonzero((cell == c) & (label == value))
            if len(own):
                out[c, value] = np.concatenate([share[own].sum(0), (share[own].T @ z[own]).ravel(), (z[own].T @ z[own]).ravel()])
    return out


def _pairs(sums: Sums, d: int, w: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and about the curvature of the mean logistic loss over all pairs of a good and a bad document."""
    held = {}
    for value in (0, 1):
        cells = sorted(c for c, v in sums if v == value)
        x = np.stack([sums[c, value] for c in cells])
        n = x[:, :NODES]
        at = np.array(cells)[:, None] + _nodes()
        held[value] = at, n, x[:, NODES : NODES * (1 + d)].reshape(-1, NODES, d), x[:, NODES * (1 + d) :].reshape(-1, d, d), (n * at).sum(1) / n.sum(1)
    bad_at, bad_n, bad_z, bad_zz, bad_mid = held[0]
    loss, grad, curve = 0.0, np.zeros(d), np.zeros((d, d))
    flat_n, flat_z = bad_n.ravel(), bad_z.reshape(-1, d)
    total, sum_z = bad_n.sum(1), bad_z.sum(1)
    for at, n, z, zz, mid in zip(*held[1], strict=True):
        apart = bad_at.ravel() - at[:, None]
        loss += float(n @ np.logaddexp(0, apart) @ flat_n)
        lost = 1 / (1 + np.exp(-np.clip(apart, -500, 500)))
        grad += (n @ lost) @ flat_z - (lost @ flat_n) @ z
        p = 1 / (1 + np.exp(-np.clip(bad_mid - mid, -500, 500)))
        bend = p * (1 - p)
        cross = np.outer(z.sum(0), bend @ sum_z)
        curve += zz * (bend @ total) + n.sum() * np.tensordot(bend, bad_zz, 1) - cross - cross.T
    pairs = held[1][1].sum() * bad_n.sum()
    return loss / pairs + ridge / 2 * w @ w, grad / pairs + ridge * w, curve / pairs + ridge * np.eye(d)


def _weights(sums: Callable[[np.ndarray], Sums], d: int, ridge: float) -> np.ndarray:
    """Newton's method on the mean logistic loss of all pairs, with smaller steps where it would rise; sums: those of `_by_cell` for weights."""
    best, step = np.zeros(d), np.zeros(d)
    least = np.inf
    for _ in range(STEPS):
        w = best + step
        loss, grad, curve = _pairs(sums(w), d, w, ridge)
        if loss > least + 1e-13:
            step = step / 2
        else:
            best, least, step = w, loss, -np.linalg.solve(curve, grad)
        if np.abs(step).max() < CLOSE:
            break
    return best


def _drawn(z: np.ndarray, good: np.ndarray, bad: np.ndarray, pairs: int, ridge: float) -> np.ndarray:
    """Weights from so many pairs."""
    rng = np.random.default_rng(11)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d / pairs + ridge * np.eye(len(w)), d.T @ (1 - p) / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < CLOSE:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, bad_share: float, pairs: int | None = None, ridge: float = 1e-3) -> QualityModel:
    """Learn from feature rows and 0/1 labels that are at hand, from all pairs or `pairs` drawn ones. Without both labels all strengths are equal and all scores are above CUT (no bad ones) or below it."""
    mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    scale = np.maximum(1e-9, x.std(0)) if len(x) else np.ones(x.shape[1])
    z = _standard(x, mean, scale)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return QualityModel(mean, scale, np.zeros(x.shape[1]), 1.0 if len(bad) else -1.0, 1.0)
    w = _drawn(z, good, bad, pairs, ridge) if pairs else _weights(lambda w: _by_cell(z, label, w), x.shape[1], ridge)
    s = z @ w
    # the quantile among rows weighted as the labels are
    weight = np.where(label == 1, (1 - bad_share) / len(good), bad_share / len(bad))
    order = np.argsort(s, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), bad_share))
    threshold = (s[order[min(at, len(s) - 1)]] + s[order[max(0, at - 1)]]) / 2
    return QualityModel(mean, scale, w, float(threshold), 1.0)


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a batch (label, x)."""
    return batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)), batch.column(0).to_numpy()


def _summed(table: DataFrame, each: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
    """The sums of `each` over all rows (label, x), a cell's from all tasks in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Sums = {}
        for batch in batches:
            if batch.num_rows:
                for key, x in each(*_rows(batch)).items():
                    own[key] = own[key] + x if key in own else x
        if own:
            keys = sorted(own)
            columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([own[k].tolist() for k in keys], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "label", "sums"])

    def together(t: pa.Table) -> pa.Table:
        x = np.sum(t.column("sums").to_pylist(), axis=0)
        return pa.table({"cell": t.column("cell").slice(0, 1), "label": t.column("label").slice(0, 1), "sums": pa.array([x.tolist()], pa.list_(pa.float64()))})

    kind = "cell long, label long, sums array<double>"
    found = table.mapInArrow(run, kind).groupBy("cell", "label").applyInArrow(together, kind).collect()
    return {(r.cell, r.label): np.array(r.sums) for r in found}


def _quantile(strengths: DataFrame, weights: dict[int, float], share: float) -> float:
    """Halfway between the least strength at which the weighted rows (label, s) reach the share and the next one below; exact, by passes over ever narrower bins."""
    low, high = strengths.agg(F.min("s"), F.max("s")).first()
    before, within = 0.0, strengths
    while low < high:
        at = F.least(F.floor((F.col("s") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = within.groupBy(at.alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).orderBy("bin").collect()
        for r in bins:
            own = r.good * weights[1] + (r.n - r.good) * weights[0]
            if before + own >= share - 1e-12 or r is bins[-1]:
                break
            before += own
        low, high = r.low, r.high
        within = strengths.filter(F.col("s").between(low, high))
    below = strengths.filter(F.col("s") < low).agg(F.max("s")).first()[0]
    return (low + (low if below is None else below)) / 2


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", ridge: float = 1e-3) -> QualityModel:
    """Fit on all labelled documents and all pairs of them; the share of bad ones is that of all labels. Rows with a null id or label are left out, and of documents of one id the one with the least digest counts."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    own = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast(kind).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in own.groupBy("label").count().collect()}
    bad_share = counts.get(0, 0) / max(1, sum(counts.values()))
    rows = likely_ids(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), own.select("id"), "id")
    found = described(rows.select("id", F.xxhash64("text").alias("digest"), "text"), ["id", "digest"]).join(own.distinct(), "id").groupBy("label", "id").agg(F.min_by("x", "digest").alias("x"))
    table, path = write_table(found.select("label", "x"), "quality")
    d = len(FEATURES)
    sums = _summed(table, lambda x, label: {(0, v): np.concatenate([[(label == v).sum()], x[label == v].sum(0)]) for v in (0, 1)})
    n = {v: int(sums[0, v][0]) if sums else 0 for v in (0, 1)}
    mean = (sums[0, 0] + sums[0, 1])[1:] / (n[0] + n[1]) if sums else np.zeros(d)
    if not n[0] or not n[1]:
        drop_table(docs.sparkSession, path)
        return QualityModel(mean, np.ones(d), np.zeros(d), 1.0 if n[0] else -1.0, 1.0)
    squares = _summed(table, lambda x, label: {(0, 0): ((x - mean) ** 2).sum(0)})[0, 0]
    scale = np.maximum(1e-9, np.sqrt(squares / (n[0] + n[1])))
    w = _weights(lambda w: _summed(table, lambda x, label: _by_cell(_standard(x, mean, scale), label, w)), d, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = _rows(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_standard(x, mean, scale) @ w)], names=["label", "s"])

    strengths, strengths_path = write_table(table.mapInArrow(run, "label int, s double"), "strengths")
    threshold = _quantile(strengths, {0: bad_share / n[0], 1: (1 - bad_share) / n[1]}, bad_share)
    for x in (path, strengths_path):
        drop_table(docs.sparkSession, x)
    return QualityModel(mean, scale, w, float(threshold), 1.0)


def described(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` and x array<double>, the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(len(keep)))
            for i, j in K.chunks(start, end):
                x = features(*K.gather(data, start[i:j], end[i:j]))
                lists = K.lists(x.ravel(), np.full(len(x), x.shape[1]))
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), lists], names=[*keep, "x"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text_col).mapInArrow(run, f"{kinds}, x array<double>")


def rate(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, score double (0 to 1) and predicted int.

    A null text is as an empty one, which has a score like any other. Rows with
    a null id, and repeated rows, are rows like any other; other columns are not
    looked at; an empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            for i, j in K.chunks(start, end):
                score = shared.value.scores(features(*K.gather(data, start[i:j], end[i:j])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, score double, predicted int"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, kind)


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the quality of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = learn(docs, labels.filter(~held_out("doc_id")))
    return rate(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
