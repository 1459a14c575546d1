"""Operator 8: exact Jaccard self-join of texts on word n-grams, and its groups.

Candidates come from the pigeonhole principle on a partition of the universe.
Shingle hashes are dealt into m segments, m by size band. Sets r and s with a
Jaccard similarity of at least t differ in at most
D = (1 - t) / (1 + t) * (|r| + |s|) shingles, so of T segments at least T - D are
equal. A record puts the contents of its first T(size) segments into an index;
in the smallest bands, where that is cheaper, a segment is indexed with its
contents less each one shingle as well (its one-deletion neighbourhood), which
counts for two.

Contents that are empty or have only very common shingles (`common`) would bring
together what is not alike. T is larger than D + 1 by a slack K, and a record
with at most K such segments leaves them out: of its equal segments one at least
is none of them. Records with more index all contents. Which shingles count as
common, and K, change the cost, never the result.

Candidates that differ too much already by a parity sketch (a lower bound of the
difference, never above it) go; every other one is verified on the words of both
texts. Records of equal sets, by 128 bits of digest and size, are one class from
the start. The few records of a usual content are all paired. The records of a
content with more are dealt into blocks, and each block is compared by sketches
with itself and the content's least record; what leaves a block is a spanning
forest of the pairs that a sketch doesn't rule out. Where records are still in
different components after that, all pairs between these components follow, block
pair by block pair; blocks of one component aren't compared with each other. No
link between groups is lost, and a large group of copies costs a number of
comparisons that grows with its members, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.operators.components import components
from siftgrain.operators.stats import row_numbers
from siftgrain.llm.store import drop_table, freed, hot_count, looked_up, only_ids, small_batches, tasks, write_table

#: Rows of the sample from which common shingles are learned, and how many are kept (8 bytes each are broadcast).
SAMPLE_ROWS, COMMON = 1 << 15, 1 << 18
#: A common shingle is in one of so many documents of the sample, at least.
COMMON_IN = 500
#: Index rows that one task sorts.
INDEX_ROWS = 1_000_000
#: Records of a content that are all paired, and records whose sketches are compared at a time.
PAIRED, BLOCK = 5, 512
#: Records of one batch from which on, in its task, a content's records don't go through the index but one.
PREPAIRED = 4
#: Records of large contents whose sketches one task gets.
COMPARED_ROWS = 20_000
#: Bits of a sketch for each bit of a set's size.
SKETCH = 4
_U64 = np.uint64


@dataclass(frozen=True)
class Scheme:
    """How the sets of one size band [low, high) are dealt into segments.

    The first `double` segments have a double share of the universe and count
    for two. For each size of the band `total` has T, in units of capacity, and
    `slack` K.
    """

    low: int
    high: int
    segments: int
    double: int
    total: np.ndarray
    slack: np.ndarray

    @property
    def capacity(self) -> int:
        return self.segments + self.double

    def least_slack(self, low: int, high: int) -> int:
        """The least K of sizes low to high."""
        return int(self.slack[max(0, low - self.low) : high + 1 - self.low].min())

    def of_capacity(self, total: int) -> int:
        """How many segments come to this capacity."""
        return min(self.segments, (total + 1) // 2 if total <= 2 * self.double else total - self.double)


def scheme(band: int, threshold: Fraction) -> Scheme:
    """The scheme for sizes of 2**band to 2**(band + 1), with the cheapest number of double segments.

    T leaves room for as many empty segments as a set of the size has, and four
    standard deviations more. The cost is the index rows of a set of the band's
    mean size, and those that it adds where it has more empty segments than K.
    """
    low, high = 1 << band, 2 << band
    sizes, share = np.arange(low, high), (1 - threshold) / (1 + threshold)
    # in how many shingles a set and a larger one can differ, and one more
    least = np.array([floor(share * (n + floor(n / threshold))) + 1 for n in sizes.tolist()])
    best = None
    for double in range(1 + (int(least[-1]) + 2) // 2 if high <= 64 else 1):
        capacity = max(int(least[-1]) + 1, 2 * double + 1)
        for _ in range(8):
            empty = np.exp(-sizes / capacity)
            total = np.maximum.accumulate(np.ceil((least + 4 * np.sqrt(least * empty) + 1) / (1 - empty)).astype(np.int64))
            if total[-1] <= capacity or capacity >= 1.35 * least[-1]:
                break
            capacity = int(min(total[-1], ceil(1.35 * least[-1]) + 1))
        total = np.maximum(np.minimum(total, capacity), min(2 * double, capacity))
        slack = total - least
        unit = sizes / capacity
        weak = (total - 2 * double) * np.exp(-unit) + 2 * double * np.exp(-2 * unit) * (1 + unit)
        rows = (total - 2 * double) * (1 - np.exp(-unit)) + double * (1 + 2 * unit)
        risk = np.exp(-np.maximum(0, slack - weak))
        cost = float((rows + 10 * risk * weak).mean())
        if best is None or cost < best[0]:
            best = (cost, Scheme(low, high, capacity - double, double, total, slack))
    return best[1]


def shingle_hashes(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending 64-bit hashes; fewer than n words are one shingle."""
    words, _, _, first = K.word_hashes(data, at, K.NOT_SPACE)
    whole, out = K.sequence_hash(words, n), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(whole[a : b - n + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif b > a:
            out.append(K.mix(K.sequence_hash(words[a:b], b - a) + _U64(b - a)))
        else:
            out.append(np.zeros(0, _U64))
    return out


def exact_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending numbers; the same words, byte by byte, have the same number in all of the texts."""
    data = K.LOWER[data]
    start, end, first = K.word_spans(data, at, K.NOT_SPACE)
    word = K.distinct_spans(data, start, end)[1].astype(np.int64)
    run, size = word, 1  # numbers of the runs of `size` words from each word on
    while size < n and len(run):
        step = min(size, n - size)
        run = np.unique(run[:-step] * (run.max() + 1) + run[step:], return_inverse=True)[1].astype(np.int64)
        size += step
    short: dict[tuple[int, ...], int] = {}
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(run[a : b - n + 1]))
        else:  # the whole sequence, below 0
            out.append(np.array([-1 - short.setdefault(tuple(word[a:b].tolist()), len(short))] if b > a else [], np.int64))
    return out


def contents(s: np.ndarray, rare: np.ndarray, plan: Scheme, role: int, least: int) -> np.ndarray:
    """The index keys of a set under a scheme: the role's size gives T, and the least size of a partner gives K.

    rare: which of the set's shingles aren't common.
    """
    n = plan.of_capacity(int(plan.total[role - plan.low]))
    unit = ((s >> _U64(32)) * _U64(plan.capacity)) >> _U64(32)
    edges = np.arange(n + 1)
    edges = np.where(edges <= plan.double, 2 * edges, edges + plan.double).astype(_U64)
    at = np.searchsorted(unit, edges)
    values = K.mix(s ^ _U64(0x2545F4914F6CDD1D))
    sums = np.concatenate([np.zeros(1, _U64), np.cumsum(values)])
    body = sums[at[1:]] - sums[at[:-1]]
    strong = np.diff(np.concatenate([[0], np.cumsum(rare)])[at])
    d = min(plan.double, n)
    weak = int((strong[d:] == 0).sum() + 2 * (strong[:d] == 0).sum() + (strong[:d] == 1).sum())
    all_ = weak > plan.least_slack(least, role)
    salt = K.mix((np.arange(n) + (plan.low << 24)).astype(_U64))
    keys = [(body + salt)[(strong > 0) | all_]]
    for j in range(d):
        a, b = at[j], at[j + 1]
        less = strong[j] - rare[a:b] > 0
        keys.append((body[j] - values[a:b] + salt[j])[less | all_])
    return K.mix(np.concatenate(keys))


def index_keys(s: np.ndarray, rare: np.ndarray, threshold: Fraction, plans: dict[int, Scheme]) -> np.ndarray:
    """All index keys of a set: of its own band, and of the band below if a partner can be there."""
    size = len(s)
    band = size.bit_length() - 1
    least = ceil(size * threshold)

    def plan(b: int) -> Scheme:
        if b not in plans:
            plans[b] = scheme(b, threshold)
        return plans[b]

    own = plan(band)
    keys = contents(s, rare, own, size, least)
    if least < own.low:
        keys = np.concatenate([keys, contents(s, rare, plan(band - 1), own.low - 1, least)])
    return keys


def _long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def common_shingles(texts: DataFrame, n: int, rows: int) -> np.ndarray:
    """Shingles that many documents of a bounded sample hold, ascending; at most COMMON of them."""
    every = max(1, -(-rows // SAMPLE_ROWS))
    sample = texts.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(1))
            for i, j in K.chunks(start, end):
                own, at = K.gather(data, start[i:j], end[i:j])
                found, times = np.unique(np.concatenate(shingle_hashes(own, at, n)), return_counts=True)
                found, times = found[times > 1], times[times > 1]  # what is common shows within a batch
                yield pa.RecordBatch.from_arrays([pa.array(_long(found)), pa.array(times)], names=["h", "times"])

    counted = sample.mapInArrow(count, "h long, times long").groupBy("h").agg(F.sum("times").alias("times")).filter(F.col("times") >= max(4, min(rows, SAMPLE_ROWS) // COMMON_IN))
    top = counted.orderBy(F.desc("times"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(_U64))


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of the counts of a set's hashes by their low bits, as 64-bit words (a power of 2 of them).

    Sets differ in at least as many elements as the sketches in bits.
    """
    bits = SKETCH << max(6, len(s).bit_length() - 1)
    odd = np.bincount((s & _U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts: DataFrame, n: int, threshold: Fraction, common: np.ndarray, key_bits: int) -> DataFrame:
    """id, size, two halves of the set's digest, sketch, keys (of the first of equal sets in a task) and the given digest for every (id, text, digest).

    Of a key that several records of a batch have, only the least record's goes
    on; the others, and all later ones of the task, are in `near` as (key, that
    record, record). So a task sends few rows of a key, however common it is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, Scheme] = {}
        seen: set[tuple[int, int, int]] = set()
        hot = (np.zeros(0, _U64), np.zeros(0, np.int64))  # keys that several records had, and the record that stands for each
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, start, end = K.text_bytes(batch.column(1))
            size = np.zeros(len(ids), np.int64)
            digest = np.zeros((2, len(ids)), _U64)
            keys, owner, sketches = [], [], []
            for i, j in K.chunks(start, end):
                own, at = K.gather(data, start[i:j], end[i:j])
                sets = shingle_hashes(own, at, n)
                flat = np.concatenate(sets)
                place = np.searchsorted(shared.value, flat)
                rare = np.ones(len(flat), bool)
                inside = place < len(shared.value)
                rare[inside] = shared.value[place[inside]] != flat[inside]
                a = 0
                for k, s in enumerate(sets, i):
                    b = a + len(s)
                    size[k] = len(s)
                    sketches.append(sketch(s))
                    if len(s):
                        digest[0, k] = s.sum()
                        digest[1, k] = K.mix(s + _U64(0x632BE59BD9B4E019)).sum()
                        mark = (len(s), int(digest[0, k]), int(digest[1, k]))
                        if mark not in seen:
                            seen.add(mark)
                            keys.append(index_keys(s, rare[a:b], threshold, plans) >> _U64(64 - key_bits))
                            owner.append(np.full(len(keys[-1]), k))
                    a = b
            out, hot = _keyed(ids, size, digest, sketches, keys, owner, hot)
            yield out.append_column("digest", batch.column(2))

    kind = "id long, size long, h1 long, h2 long, sketch array<long>, keys array<long>, near array<struct<key: long, a: long>>, digest long"
    return texts.mapInArrow(run, kind)


def _keyed(ids, size, digest, sketches, keys, owner, hot_) -> tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]:
    """The rows of _sets, and hot_ with the keys that this batch adds."""
    key = np.concatenate(keys) if keys else np.zeros(0, _U64)
    row = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.lexsort((ids[row], key))
    key, row = key[order], row[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(key)))
    place = np.minimum(np.searchsorted(hot_[0], key[at]), max(0, len(hot_[0]) - 1))
    known = hot_[0][place] == key[at] if len(hot_[0]) else np.zeros(len(at), bool)
    stands = np.where(known, hot_[1][place], ids[row[at]]) if len(hot_[0]) else ids[row[at]]
    fresh = ~known & (many >= PREPAIRED)
    grown = np.concatenate([hot_[0], key[at][fresh]])
    by_key = np.argsort(grown, kind="stable")
    held = (grown[by_key], np.concatenate([hot_[1], stands[fresh]])[by_key])
    hot = np.repeat(known | fresh, many)
    of = np.repeat(stands, many)
    n = len(ids)

    def lists(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(mask)
        at = at[np.argsort(row[at], kind="stable")]
        return at, np.bincount(row[at], minlength=n)

    usual, n_usual = lists(~hot)
    more, n_more = lists(hot & (ids[row] != of))
    near = pa.StructArray.from_arrays([pa.array(_long(key[more])), pa.array(of[more])], names=["key", "a"])
    near_at = pa.array(np.concatenate([[0], np.cumsum(n_more)]).astype(np.int32))
    flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
    columns = [
        pa.array(ids),
        pa.array(size),
        pa.array(_long(digest[0])),
        pa.array(_long(digest[1])),
        K.lists(flat, np.array([len(x) for x in sketches], np.int64)),
        K.lists(_long(key[usual]), n_usual),
        pa.ListArray.from_arrays(near_at, near),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["id", "size", "h1", "h2", "sketch", "keys", "near"]), held


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b) of index rows (key, id, hot). All rows of a key are here.

    Of a key with few records all pairs, each pair once and without the key;
    else, and of a hot key, (key, record, null).
    """
    K.settle()
    parts = [tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)) for b in batches if b.num_rows]
    if not parts:
        return
    key, own, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same]) | hot[order]
    key, own, hot = key[keep], own[order[keep]], hot[order[keep]]
    if not len(key):
        return
    order = np.lexsort((own, key))
    key, own, hot = key[order], own[order], hot[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.diff(np.append(at, len(key)))
    large = np.repeat((many > PAIRED) | np.logical_or.reduceat(hot, at), many)
    pairs = []
    for step in range(1, PAIRED):
        i = np.flatnonzero((key[step:] == key[:-step]) & ~large[step:] & (own[step:] != own[:-step]))
        pairs.append(np.stack([own[i], own[i + step]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    for k in range(0, len(pairs), 1 << 16):
        part = pairs[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(part[:, 0]), pa.array(part[:, 1])], names=["key", "a", "b"])
    more = np.flatnonzero(large)
    for k in range(0, len(more), 1 << 16):
        part = more[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(own[part]), pa.nulls(len(part), pa.int64())], names=["key", "a", "b"])
    del key, own, hot, order, large, pairs
    K.settle()


def _block(of, n):
    """Which of n blocks a member is in."""
    return F.pmod(F.xxhash64(of), n).cast("int")


def _own_units(members: DataFrame, rows: int) -> DataFrame:
    """(key, x, y, side, id, label) of (key, id, label): each member in its block, and the key's least member in all of them."""
    held = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("centre")).filter("n > 1")
    hot = held.filter(F.col("n") >= hot_count(rows))
    own = looked_up(members, held.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), hot, ["key"], "inner")
    blocks = F.when(F.col("id") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(_block("id", F.col("blocks"))))
    own = own.withColumn("x", F.explode(blocks)).withColumn("x", F.col("x").cast("long"))
    return own.select("key", "x", F.col("x").alias("y"), F.lit(0).alias("side"), "id", "label")


def _cross_units(members: DataFrame, rows: int) -> DataFrame:
    """(key, x, y, side, id, label) of (key, id, label): block pairs that may hold members of different labels.

    Of a label with BLOCK members or more in a key the blocks hold nothing else,
    and aren't paired with each other; all other members of a key share blocks.
    """
    groups = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    pure = F.when(F.col("n") >= BLOCK, F.struct("label", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    held = groups.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.collect_list(pure).alias("pure"), F.ceil(F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("mixed"))
    held = held.filter("labels > 1").drop("labels")
    own = looked_up(members, held.drop("n"), held.filter(F.col("n") >= hot_count(rows)), ["key"], "inner")
    own = own.withColumn("whole", F.filter("pure", lambda p: p["label"] == F.col("label")))
    alone = F.size("whole") > 0
    name = lambda label, k: F.xxhash64(label, k)  # noqa: E731  equal names by chance bring two blocks together, which costs nothing but time
    no = F.lit(None).cast("long")
    mine = F.when(alone, name(F.col("label"), _block("id", F.col("whole")[0]["blocks"]))).otherwise(name(no, _block("id", F.greatest(F.col("mixed"), F.lit(1)))))
    mixed = F.transform(F.filter(F.sequence(F.lit(0), F.col("mixed")), lambda k: k < F.col("mixed")), lambda k: name(no, k))
    others = F.flatten(F.transform(F.filter("pure", lambda p: p["label"] != F.col("label")), lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: name(p["label"], k))))
    own = own.withColumn("own", mine).withColumn("other", F.explode(F.array_distinct(F.concat(mixed, others))))
    side = F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END")
    return own.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), side.alias("side"), "id", "label")


def _compared(units: DataFrame, known: DataFrame, threshold: Fraction, tasks_: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of members of a unit, with different labels, that sizes and sketches don't rule out: all of them, or a spanning forest of each unit.

    known: (id, size, sketch). A task gets the sketches of its units' members once.
    """
    units = units.withColumn("part", F.pmod(F.xxhash64("key", "x", "y"), F.lit(tasks_)).cast("int"))
    wanted = units.select(F.col("part").alias("task"), F.col("id").alias("own")).distinct().join(known.toDF("own", "size", "sketch"), "own")

    def close(size: np.ndarray, words: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) of the pairs of left and right."""
        found = []
        kinds = np.array([len(w) for w in words])
        for wide in np.unique(kinds[left]).tolist():
            for other in np.unique(kinds[right]).tolist():
                i, j = left[kinds[left] == wide], right[kinds[right] == other]
                w = min(wide, other)

                def folded(rows, w=w):
                    x = np.stack([words[k] for k in rows])
                    while x.shape[1] > w:
                        half = x.shape[1] // 2
                        x = x[:, :half] ^ x[:, half:]
                    return x

                a, b = folded(i), folded(j)
                step = max(1, (1 << 19) // max(1, b.size))
                for k in range(0, len(i), step):
                    part = i[k : k + step]
                    far = np.bitwise_count(a[k : k + step, None] ^ b[None]).sum(2, dtype=np.int64)
                    na, nb = size[part][:, None], size[j][None]
                    most = (na + nb) * (threshold.denominator - threshold.numerator) // (threshold.denominator + threshold.numerator)
                    fits = (far <= most) & (label[part][:, None] != label[j][None])
                    fits &= np.minimum(na, nb) * threshold.denominator >= np.maximum(na, nb) * threshold.numerator
                    p, q = np.nonzero(fits)
                    found.append((part[p], j[q], far[p, q]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def tree(n: int, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs: from each tree's first member outwards, each next one by its closest link."""
        a, b, d = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
        order = np.argsort(d, kind="stable")
        a, b = a[order], b[order]
        done = np.zeros(n, bool)
        out = []
        while len(a):
            front = np.zeros(n, bool)
            front[a.min()] = True
            while front.any():
                done |= front
                edge = np.flatnonzero(front[a] & ~done[b])
                first = np.unique(b[edge], return_index=True)[1]
                out.append(np.stack([a[edge[first]], b[edge[first]]]))
                front = np.zeros(n, bool)
                front[b[edge]] = True
            rest = ~done[a]
            a, b = a[rest], b[rest]
        both = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
        return both[0], both[1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        K.settle()
        key, x, y, side, own, label = (left.column(c).to_numpy() for c in ("key", "x", "y", "side", "id", "label"))
        ids, size = right.column("own").to_numpy(), right.column("size").to_numpy()
        sketches = right.column("sketch").combine_chunks()
        offsets, flat = np.asarray(sketches.offsets).astype(np.int64), np.asarray(sketches.values).view(_U64)
        by_id = np.argsort(ids)
        row = by_id[np.searchsorted(ids[by_id], own)] if len(ids) else np.zeros(0, np.int64)
        order = np.lexsort((own, y, x, key))
        new = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]) if len(order) else np.zeros(0, bool)
        at = np.append(np.flatnonzero(new), len(order))
        pairs = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = order[a:b]
            words = [flat[offsets[k] : offsets[k + 1]] for k in row[rows].tolist()]
            lefts, rights = np.flatnonzero(side[rows] != 2), np.flatnonzero(side[rows] != 1)
            if not len(lefts) or not len(rights):
                continue
            i, j, far = close(size[row[rows]], words, label[rows], lefts, rights)
            keep = own[rows][i] < own[rows][j] if (side[rows] == 0).all() else own[rows][i] != own[rows][j]
            i, j, far = i[keep], j[keep], far[keep]
            if forest:
                i, j = tree(len(rows), i, j, far)
            pairs.append(np.stack([own[rows][i], own[rows][j]], 1))
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
        pairs.clear()
        K.settle()
        return pa.Table.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return units.groupBy("part").cogroup(wanted.groupBy("task")).applyInArrow(run, "a long, b long").distinct()


def _likely(pairs: DataFrame, known: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches don't rule out a link. known: id, size, sketch."""
    left, right = known.toDF("a", "na", "sa"), known.toDF("b", "nb", "sb")
    both = pairs.join(right, "b").join(left, "a")
    fits = F.least("na", "nb") * threshold.denominator >= F.greatest("na", "nb") * threshold.numerator

    def folded(own: str, other: str):
        half = F.size(own) / 2
        fold = F.zip_with(F.slice(own, 1, F.size(own).cast("int") - half.cast("int")), F.slice(own, half.cast("int") + 1, half.cast("int")), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), fold).otherwise(F.col(own))

    bits = F.zip_with(folded("sa", "sb"), folded("sb", "sa"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda s, x: s + x)
    t = threshold
    most = F.floor((F.col("na") + F.col("nb")) * (t.denominator - t.numerator) / (t.denominator + t.numerator))
    return both.filter(fits).filter(apart <= most).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough. texts: id, text."""
    both = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")

    def alike(left: pa.Array, right: pa.Array, new: np.ndarray) -> list[bool]:
        """Of each right text and the left one of its row; left holds those of the rows where `new` is set."""
        rows = [K.text_bytes(left), K.text_bytes(right)]
        parts = [K.gather(*x)[0] for x in rows]
        at = np.concatenate([[0], np.cumsum(np.concatenate([end - start for _, start, end in rows]))])
        sets = exact_sets(np.concatenate(parts), at, n)
        out = []
        for k, r in zip((np.cumsum(new) - 1).tolist(), sets[len(left) :], strict=True):
            common = len(np.intersect1d(sets[k], r, assume_unique=True))
            out.append(common * threshold.denominator >= (len(sets[k]) + len(r) - common) * threshold.numerator)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, start, end = K.text_bytes(whole.column(3))
            for i, j in K.chunks(start, end):
                batch = whole.slice(i, j - i)
                first = batch.column(0).to_numpy()
                new = np.concatenate([[True], first[1:] != first[:-1]])  # rows of one a follow each other after the join
                keep = pa.array(alike(batch.column(2).filter(pa.array(new)), batch.column(3), new))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, by_row: bool = False) -> DataFrame:
    """For each row of df: id, n_shingles and component_id (the least id that links lead to, itself included).

    Two texts link when the Jaccard similarity of their sets of word n-grams is
    at least the threshold (0.5 or more, else ValueError). A null or empty text, or one of white space, has no
    shingles and links with nothing; a text of 1 to n - 1 words has one. Ids are
    whole numbers; rows with a null id are left out of the links and come back
    with a null component. Repeated rows come back repeated; rows of one id and
    different texts are compared each by itself. Other columns,
    whatever their names, are not looked at. Empty tables give empty results.
    by_row: with digest (xxhash64 of the text) and first, whether the row is
    the one that stands for its group; equal rows all are, and rows with a null id.
    """
    if threshold < 0.5:
        raise ValueError("sets of less than half the size aren't compared")
    small_batches(df.sparkSession)
    spark, share = df.sparkSession, Fraction(str(threshold))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    known = texts.filter("id IS NOT NULL")
    count = known.count()
    common = common_shingles(known, n, count)
    key_bits = min(63, 24 + (count + 1).bit_length())
    table, path = write_table(_sets(known, n, share, common, key_bits), "shingle-keys")
    sets = F.struct("size", "h1", "h2")
    if table.groupBy("id").agg((F.min(sets) != F.max(sets)).alias("several")).filter("several").limit(1).count():
        drop_table(spark, path)
        out = _numbered(known, count, n, threshold)
    else:
        out = _grouped(table, known, count, n, share)
        drop_table(spark, path)
    lost = _sets(texts.filter("id IS NULL").withColumn("id", F.lit(0).cast("long")), n, share, common, key_bits)
    null = F.lit(None).cast("long")
    out = out.union(lost.select(null, "size", null, "digest", F.lit(True))).toDF(id_col, "n_shingles", "component_id", "digest", "first")
    return out if by_row else out.drop("digest", "first")


def _numbered(known: DataFrame, count: int, n: int, threshold: float) -> DataFrame:
    """The result where rows of one id have different texts: (id, digest of the text) get numbers in their order, which stand for ids."""
    spark = known.sparkSession
    number, path = write_table(row_numbers(known.select("id", "digest").distinct(), ["id", "digest"], "number"), "numbers")
    named, named_path = write_table(known.join(number, ["id", "digest"]).select("number", "text"), "numbered")
    groups, groups_path = write_table(similar_groups(named, "number", "text", n, threshold, by_row=True), "groups")
    # the component of the least number is the one of the least id
    own = groups.drop("digest").join(number, "number")
    least = number.select(F.col("number").alias("component_id"), F.col("id").alias("component"))
    hot = groups.groupBy("component_id").count().filter(F.col("count") >= hot_count(count))
    out, _ = write_table(looked_up(own, least, hot, ["component_id"]).select("id", "n_shingles", "component", "digest", "first"), "groups")
    for p in (path, named_path, groups_path):
        drop_table(spark, p)
    return out


def _grouped(table: DataFrame, known: DataFrame, count: int, n: int, share: Fraction) -> DataFrame:
    """(id, n_shingles, component, digest, first) of the rows of _sets, where rows of one id have one set. known: (id, text, digest)."""
    spark = known.sparkSession
    sizes = table.select("id", "size", "h1", "h2", "digest")

    # equal sets: one class, named by its least id
    equal = ["size", "h1", "h2"]
    full = sizes.filter("size > 0")
    classes, classes_path = write_table(full.groupBy(*equal).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
    hot = classes.filter(F.col("copies") >= hot_count(count))
    copies = looked_up(full, classes.drop("copies"), hot, equal, "inner").filter("id != rep").select("id", "rep").distinct()
    copies, copies_path = write_table(copies, "copies")

    rows = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    near = table.select(F.explode("near").alias("x"), "id").select("x.key", "x.a", F.col("id").alias("b"))
    index = table.select(F.explode("keys").alias("key"), "id", F.lit(False).alias("hot")).union(near.select("key", "a", F.lit(True)).distinct())
    index = index.repartition(tasks(spark, rows, INDEX_ROWS), "key")
    met = index.mapInArrow(_paired, "key long, a long, b long").union(near.select("key", F.col("b"), F.lit(None).cast("long")))
    met, met_path = write_table(met, "met")
    freed(spark)

    def named(frame: DataFrame, column: str) -> DataFrame:
        """frame with the class's least id instead of an id."""
        by = copies.toDF(column, "rep")
        return frame.join(by, column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")

    described = table.select("id", "size", "sketch").dropDuplicates(["id"])
    pairs = named(named(met.filter("key IS NULL").select("a", "b").distinct(), "a"), "b").filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    members = named(met.filter("key IS NOT NULL").select("key", F.col("a").alias("id")), "id").distinct()
    members, members_path = write_table(members, "members")
    many = members.count()
    parts = 1 + many // COMPARED_ROWS
    near_ones = _compared(_own_units(members.withColumn("label", F.col("id")), many), described, share, parts, forest=True)
    first, first_path = write_table(_likely(pairs, described, share).union(near_ones).distinct(), "pairs")

    def verified(these: DataFrame) -> tuple[DataFrame, str]:
        wanted = these.select(F.col("a").alias("id")).union(these.select(F.col("b").alias("id"))).distinct()
        bodies, bodies_path = write_table(only_ids(known.select("id", "text"), wanted, "id").dropDuplicates(["id"]), "texts")
        out = write_table(_verified(these, bodies, n, share), "links")
        drop_table(spark, bodies_path)
        return out

    links, links_path = verified(first)
    joined = components(links)

    # contents whose records aren't all in one component by now
    label = joined.toDF("id", "label")
    members = members.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    rest = _compared(_cross_units(members, many), described, share, parts, forest=False).join(first, ["a", "b"], "left_anti")
    rest, rest_path = write_table(rest, "more-pairs")
    more, more_path = verified(rest)
    if more.limit(1).count():
        joined = components(links.union(more))
    label = joined.toDF("rep", "label")

    out = sizes.join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = looked_up(out, label, hot.select("rep"), ["rep"]).select("id", F.col("size").alias("n_shingles"), F.coalesce("label", "rep").alias("component"), "digest")
    out = out.withColumn("first", F.col("id") == F.col("component"))
    out, _ = write_table(out, "groups")
    for p in (classes_path, copies_path, met_path, members_path, first_path, links_path, rest_path, more_path):
        drop_table(spark, p)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: groups of documents that share at least 80 % of their 5-word shingles."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM one x JOIN one y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM met WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least USING (doc_id)
"""
