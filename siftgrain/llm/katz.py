"""Operator 4: language-model scoring by Katz backoff.

An n-gram (context, word) that training has c > 0 times has the probability
d(c) c / c(context), with the Good-Turing discount d; the mass that a context's
discounts leave goes to the words it hasn't, in proportion to the next lower
order: P(word | context) = a(context) P(word | shorter context), where
a(context) = (1 - sum of its own) / (1 - sum of the same words' lower ones), over
exactly the words it has. Each distribution sums to 1 over the training types
and one type for all unknown words.

Texts become units of tokens, written once and bucketed by unit. Order by order
the units send their distinct n-grams, with training counts and the counts of
the lower order, to tables partitioned by context; back come, for each n-gram that
a unit asked for, its count, and for each context that has words which the unit
doesn't, how many words it has once, twice, ..., and the sum of their discounted
lower-order counts (a seen word's lower-order probability is that count over a
total, which is the same for all words of a context). From these each unit evaluates its tokens recursively. A context
with very many occurrences is split by word into as many contexts as its count
calls for; a unit that has it asks each of them, and adds up what they answer.

Words and n-grams are named by 64-bit hashes that no pattern of bytes makes
collide; two of a billion distinct ones do so by chance once in 37 corpora.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.store import drop_table, freed, shared_folder, small_batches, write_table

#: Text bytes of a unit, tokens that one task counts, and the largest count that is discounted.
UNIT_BYTES, PART_TOKENS, LARGEST = 8 << 20, 1_500_000, 5
#: Occurrences of a context from which on it is split, and those that a part of it has at most, about.
HOT_COUNT = 1 << 22
#: Buckets of the tables of units, at most.
MOST_BUCKETS = 20_000
_U64 = np.uint64
_END = _U64(0x5BD1E995A3B7C4D1)
#: Stands for what is ahead of a text.
_BEGIN = _U64(0xFFFFFFFFFFFFFFFF)
#: Stands for no word, where a unit asks for a part of a context.
_NONE = _U64(0xFFFFFFFFFFFFFFFF)


def _pack(x: np.ndarray) -> bytes:
    """Compressed, bytes of one weight together."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _open(b: bytes, kind) -> np.ndarray:
    raw = pa.decompress(memoryview(b)[8:], struct.unpack_from("<q", b)[0], codec="zstd", asbytes=True)
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.tobytes(), kind)


def _steps(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=x.dtype.type(0)))


def _from_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_open(b, _U64), dtype=_U64)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value, in ascending order, stands first, and which of them each value is. Values and places in one number sort fast."""
    low = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + low > 63:
        return np.unique(x, return_index=True, return_inverse=True)[1:]
    both = np.sort(x << low | np.arange(len(x)))
    at = both & ((1 << low) - 1)
    new = np.concatenate([[True], (both[1:] >> low) != (both[:-1] >> low)])
    back = np.empty(len(x), np.int64)
    back[at] = np.cumsum(new) - 1
    return at[new], back


def _order(x: np.ndarray) -> np.ndarray:
    """Places of 64-bit hashes in ascending order, of equal ones in their own."""
    low = _U64((1 << len(x).bit_length()) - 1)
    order = (np.sort((x & ~low) | np.arange(len(x), dtype=_U64)) & low).astype(np.int64)
    y = x[order]
    return np.argsort(x, kind="stable") if (y[1:] < y[:-1]).any() else order  # hashes that differ in their last bits only


def discounts(nr: list[int]) -> np.ndarray:
    """d[c] for counts 0 to LARGEST, from the numbers of types that occur 1 to LARGEST + 1 times.

    Katz's formula; where counts are too few for it to lie between 0 and 1, an
    absolute discount that those seen once and twice give.
    """
    k = LARGEST
    n = [0, *nr]
    d = np.ones(k + 1)
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    d_abs = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    for r in range(1, k + 1):
        value = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
        d[r] = value if 0 < value < 1 else (r - d_abs) / r
    return d


def unigram_probability(count: np.ndarray, stats: dict) -> np.ndarray:
    """Of words by their training counts; that of count 0 is what all unknown words have together."""
    return np.where(count > 0, discounted(count, stats) * stats["scale"] / max(1, stats["total"]), stats["left"])


def discounted(count: np.ndarray, stats: dict) -> np.ndarray:
    """Counts of a level less their discounts."""
    return np.where(count > LARGEST, 1.0, discounts(stats["nr"])[np.minimum(count, LARGEST)]) * count


def _tokenized(docs: DataFrame) -> DataFrame:
    """(id, train, text) as units (unit, ids, train, sizes, words, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, unit = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, start, end = K.text_bytes(batch.column(2))
            for i, j in K.chunks(start, end, UNIT_BYTES):
                hashes, sizes = [], []
                for a, b in K.chunks(start[i:j], end[i:j]):
                    h, _, _, first = K.word_hashes(*K.gather(data, start[i + a : i + b], end[i + a : i + b]), K.NOT_SPACE)
                    hashes.append(np.insert(h, first[1:], _END))
                    sizes.append(np.diff(first) + 1)
                words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                row = pa.array([0, j - i], pa.int32())
                columns = [
                    pa.array([task << 32 | unit]),
                    pa.ListArray.from_arrays(row, batch.column(0).slice(i, j - i)),
                    pa.ListArray.from_arrays(row, batch.column(1).slice(i, j - i)),
                    pa.ListArray.from_arrays(row, pa.array(np.concatenate(sizes))),
                    pa.array([_steps(words)], pa.binary()),
                    pa.array([_pack(tokens.astype(np.int32))], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "ids", "train", "sizes", "words", "tokens"])
                unit += 1

    return docs.mapInArrow(run, "unit long, ids array<long>, train array<boolean>, sizes array<long>, words binary, tokens binary")


_WORDS = "part int, unit long, words binary, counts binary"
_ENTRIES = "part int, unit long, contexts binary, n binary, words binary, counts binary, lower binary"
#: unit is below 0 where the totals of a part are.
_ANSWERS = "level int, part int, unit long, counts binary, names binary, shared binary, sums binary, lower binary, kinds binary, total long, types long, nr array<long>"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


class _Unit:
    """A unit's tokens and, level by level, its n-grams with what the tables answer."""

    def __init__(self, r: dict, parts: int) -> None:
        self.ids, self.parts, self.unit = r["ids"], parts, r["unit"]
        self.words, self.tokens = _from_steps(r["words"]), _open(r["tokens"], np.int32).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(r["sizes"])]).astype(np.int64)
        self.train = np.repeat(np.array(r["train"], bool), r["sizes"])
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.at[:-1]] = True
        self.gram = self.tokens  # of each token the n-gram of this level that ends there

    def _spread(self, key: np.ndarray, spread: bool = False) -> np.ndarray:
        """Parts of keys; of `spread` ones, which are hashes as they are, they grow with the key."""
        return ((((key if spread else K.mix(key)) >> _U64(32)) * _U64(self.parts)) >> _U64(32)).astype(np.int64)

    def _by_word(self) -> None:
        part = self._spread(self.words)
        self.order = np.argsort(part, kind="stable")
        self.edges = np.searchsorted(part[self.order], np.arange(self.parts + 1))

    def unigrams(self) -> Iterator[dict]:
        """The words with their training counts, by part."""
        self._by_word()
        train = np.bincount(self.tokens[self.train], minlength=len(self.words)).astype(np.int32)
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            own = self.order[self.edges[p] : self.edges[p + 1]]
            yield {"part": p, "unit": self.unit, "words": _steps(self.words[own]), "counts": _pack(train[own])}

    def learn_unigrams(self, answers: dict[int, dict], stats: dict) -> None:
        self._by_word()
        n = len(self.words)
        self.count, self.name = np.zeros(n, np.int64), np.zeros(n, _U64)
        for p, x in answers.items():
            own = self.order[self.edges[p] : self.edges[p + 1]]
            self.count[own], self.name[own] = _open(x["counts"], np.int64), _open(x["names"], _U64)
        # words by name from here on: those of a context then go in ascending order
        by_name = np.argsort(self.name)
        rank = np.empty(n, np.int64)
        rank[by_name] = np.arange(n)
        self.count, self.name, self.gram = self.count[by_name], self.name[by_name], rank[self.tokens]
        self.by_name = self.gram
        self.p = unigram_probability(self.count, stats)
        self.per_count = np.full(n, stats["scale"] / max(1, stats["total"]))
        self.key = self.name

    def _extend(self, begin: int, hot: int) -> None:
        """The distinct n-grams of the next level, of the form (context, word), and how they are asked for: by part, context and word.

        A context of `hot` occurrences or more is split into 2, 4, ... by a hash
        of the word. Behind the n-grams come rows that ask for each part of
        such a context, whether the unit has a word of it or not.
        """
        n = len(self.key)
        context = np.where(self.first, n, np.concatenate([[0], self.gram[:-1]]))
        self.sample, self.grams = _distinct(context * len(self.words) + self.by_name)
        self.context, self.word = context[self.sample], self.by_name[self.sample]
        seen = np.append(self.count, begin)
        bits = np.maximum(0, np.ceil(np.log2(np.maximum(1, seen) / hot))).astype(np.int64)
        many = np.unique(self.context[bits[self.context] > 0])
        parts = 1 << bits[many]
        asked = np.repeat(many, parts)
        piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        own = self.name[self.word]
        of_word = (K.mix(own) >> _U64(20)).astype(np.int64) & ((1 << bits[self.context]) - 1)
        self.asking = np.concatenate([self.context, asked])
        self.asked_word = np.concatenate([own, np.full(len(asked), _NONE)])
        piece = np.concatenate([of_word, piece]).astype(_U64)
        # contexts are asked for by spread hashes of their names, which part and order come from
        self.asked = K.mix(np.append(self.key, _BEGIN)[self.asking] * _U64(0xC2B2AE3D27D4EB4F) + np.where(bits[self.asking] > 0, piece + _U64(1), _U64(0)))
        self.lower = np.append(self.count[self.gram[self.sample]], np.zeros(len(asked), np.int64))
        self.order = _order(self.asked)
        part = self._spread(self.asked[self.order], spread=True)
        self.edges = np.searchsorted(part, np.arange(self.parts + 1))

    def ask(self, begin: int, hot: int) -> Iterator[dict]:
        """The distinct n-grams of the next level with their training counts in the unit and their lower-order counts, by part."""
        self._extend(begin, hot)
        none = np.zeros(len(self.asked) - len(self.context), np.int64)
        train = np.append(np.bincount(self.grams[self.train], minlength=len(self.context)), none).astype(np.int32)
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            own = self.order[self.edges[p] : self.edges[p + 1]]
            ctx = self.asked[own]
            change = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
            yield {
                "part": p,
                "unit": self.unit,
                "contexts": _steps(ctx[change]),
                "n": _pack(np.diff(np.append(change, len(own))).astype(np.int32)),
                "words": _pack(self.asked_word[own]),
                "counts": _pack(train[own]),
                "lower": _pack(self.lower[own]),
            }

    def learn(self, level: int, answers: dict[int, dict], stats: dict, lower_stats: dict, begin: int, hot: int) -> None:
        self._extend(begin, hot)
        weight = discounted(self.lower, lower_stats)
        n, contexts = len(self.context), len(self.key) + 1
        found, sums, below = np.zeros(len(self.asked), np.int64), np.zeros((LARGEST + 1, contexts), np.int64), np.zeros(contexts)
        for p, x in answers.items():
            own = self.order[self.edges[p] : self.edges[p + 1]]
            found[own] = c = _open(x["counts"], np.int64)
            ctx = self.asked[own]
            change = np.concatenate([[True], ctx[1:] != ctx[:-1]])
            total, low = _sums(np.cumsum(change) - 1, c, weight[own])
            others = np.flatnonzero(np.unpackbits(np.frombuffer(x["shared"], np.uint8), count=total.shape[1]))
            total[:, others] = _open(x["sums"], np.int64).reshape(LARGEST + 1, -1)
            low[others] = _open(x["kinds"], np.float64)[_open(x["lower"], np.int32)]
            of = self.asking[own[change]]
            if (np.diff(np.sort(of)) > 0).all():
                sums[:, of] += total
                below[of] += low
            else:  # several parts of a context
                for k in range(LARGEST + 1):
                    np.add.at(sums[k], of, total[k])
                np.add.at(below, of, low)
        short = self.gram[self.sample]  # of each n-gram the one that is a word shorter
        count, lower, sums, below = found[:n], self.p[short], sums[:, self.context], below[self.context] * self.per_count[short]
        d = discounts(stats["nr"])
        r = np.arange(1, LARGEST + 1)
        total = r @ sums[:-1] + sums[-1]
        kept = (d[1:] * r) @ sums[:-1] + sums[-1]
        full = (sums[:-1].sum(0) == 0) & (total > 0)  # nothing is discounted: one more count for all that the context hasn't
        total, kept = total + full, kept
        some = np.maximum(1, total)
        left = (1 - kept / some) / np.maximum(1e-300, 1 - below)
        own = np.where(count > LARGEST, 1.0, d[np.minimum(count, LARGEST)]) * count / some
        self.p, self.per_count = np.where(count > 0, own, np.where(total > 0, left * lower, lower)), 1 / some
        self.key = K.mix(np.append(self.key, _BEGIN)[self.context] * _U64(0x9E3779B97F4A7C15) + self.name[self.word] + _U64(level))
        self.gram, self.count = self.grams, count

    def result(self, stats: dict, known: np.ndarray) -> pa.Table:
        c = known[self.by_name]
        base = np.log10((c + 1) / (stats["total"] + stats["types"] + 1))
        score = np.log10(self.p[self.gram])
        at = self.at[:-1]
        columns = [
            pa.array(self.ids, pa.int64()),
            pa.array(np.diff(self.at)),
            pa.array(np.add.reduceat((c > 0).astype(np.int64), at)),
            pa.array(np.full(len(at), stats["total"], np.int64)),
            pa.array(np.add.reduceat(base, at)),
            pa.array(np.add.reduceat(score, at)),
        ]
        return pa.Table.from_arrays(columns, names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _counted(rows: list[dict], parts: int) -> Iterator[dict]:
    """Answers to the unigrams of one part. A word's name grows with its rank in the part, so that frequent ones are short."""
    hashes = [_from_steps(r["words"]) for r in rows]
    _, back = np.unique(np.concatenate(hashes), return_inverse=True)
    count = np.zeros(back.max() + 1, np.int64)
    np.add.at(count, back, np.concatenate([_open(r["counts"], np.int32) for r in rows]))
    rank = np.empty(len(count), _U64)
    rank[np.argsort(-count, kind="stable")] = np.arange(len(count), dtype=_U64)
    names = rank * _U64(parts) + _U64(rows[0]["part"])
    ends = np.cumsum([len(h) for h in hashes])
    for r, a, b in zip(rows, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield {"level": 1, "part": r["part"], "unit": r["unit"], "counts": _pack(count[back[a:b]]), "names": _pack(names[back[a:b]])}
    nr = [int((count == c).sum()) for c in range(1, LARGEST + 2)]
    yield {"level": 1, "part": rows[0]["part"], "unit": -1 - rows[0]["part"], "total": int(count.sum()), "types": int((count > 0).sum()), "nr": nr}


def _sums(of: np.ndarray, count: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By context (`of`, from 0 without gaps): how many words have counts 1 to LARGEST, the sum of the larger counts, and of all words' lower-order weights."""
    n = int(of[-1]) + 1 if len(of) else 0
    by_count = [np.bincount(of[count == k], minlength=n) for k in range(1, LARGEST + 1)]
    large = np.bincount(of, np.where(count > LARGEST, count, 0), n).astype(np.int64)
    return np.stack([*by_count, large]).astype(np.int64), np.bincount(of, np.where(count > 0, lower, 0.0), n)


def _reduced(rows: list[dict], level: int, lower_stats: dict) -> Iterator[dict]:
    """Answers to the n-grams of one part."""
    contexts, sizes = [_from_steps(r["contexts"]) for r in rows], [_open(r["n"], np.int32) for r in rows]
    # each row goes by context and word, so that a stable sort of all has little to do
    named = np.unique(np.concatenate(contexts), return_index=True, return_inverse=True)[2]
    ctx = np.repeat(named, np.concatenate(sizes))
    word = np.minimum(np.concatenate([_open(r["words"], _U64) for r in rows]), _U64((1 << 40) - 1)).astype(np.int64)
    lower = discounted(np.concatenate([_open(r["lower"], np.int64) for r in rows]), lower_stats)
    given = np.concatenate([_open(r["counts"], np.int32) for r in rows])
    order = np.argsort(ctx << 40 | word, kind="stable")  # names of words are below 2**40, contexts of a part below 2**23
    c, w = ctx[order], word[order]
    new_ctx = np.concatenate([[True], c[1:] != c[:-1]])
    new = new_ctx | np.concatenate([[True], w[1:] != w[:-1]])
    head = np.flatnonzero(new)
    count = np.add.reduceat(given[order].astype(np.int64), head)
    of_ctx = np.cumsum(new_ctx)[head] - 1
    sums, below = _sums(of_ctx, count, lower[order][head])
    known = np.bincount(of_ctx, count > 0)
    count_of, ctx_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    count_of[order], ctx_of[order] = count[np.cumsum(new) - 1], np.cumsum(new_ctx) - 1
    ends = np.cumsum([int(n.sum()) for n in sizes])
    for r, n, a, b in zip(rows, sizes, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        mine = ctx_of[a:b][np.cumsum(n) - n]
        own = np.bincount(np.repeat(np.arange(len(n)), n), count_of[a:b] > 0, len(n))
        shared = known[mine] != own
        some = mine[shared]
        totals, low = sums[:, some].copy(), below[some].copy()
        # where the unit has only words that training has too (and the context is whole), what is left for others isn't asked: the total is enough
        seen = np.bincount(np.repeat(np.arange(len(n)), n), count_of[a:b] == 0, len(n))[shared] == 0
        discounted_ones = (totals[:-1].sum(0) > 0).astype(np.int64)
        total = np.arange(1, LARGEST + 1) @ totals[:-1] + totals[-1]
        totals[:, seen], low[seen] = 0, 0
        totals[0, seen], totals[-1, seen] = discounted_ones[seen], (total - discounted_ones)[seen]
        kinds, kind = np.unique(low, return_inverse=True)
        yield {"level": level, "part": r["part"], "unit": r["unit"], "counts": _pack(count_of[a:b]), "shared": np.packbits(shared).tobytes(), "sums": _pack(totals.ravel()), "lower": _pack(kind.astype(np.int32)), "kinds": _pack(kinds)}
    nr = [int((count == k).sum()) for k in range(1, LARGEST + 2)]
    yield {"level": level, "part": rows[0]["part"], "unit": -1 - rows[0]["part"], "total": int(count.sum()), "types": int((count > 0).sum()), "nr": nr}


def katz_scores(df: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", order: int = 3, hot_count: int = HOT_COUNT) -> DataFrame:
    """For each row of df: id, n_tokens, n_known, train_tokens, base_score and score.

    train: the name of a boolean column that says which rows the model learns from
    (null: not). Tokens are words of lower-cased A-Z text between ASCII white
    space, and one end; a null text is empty and has its end alone. base_score
    is the add-one unigram log10 probability, score the model's, of the given
    order. Nothing to learn from: every token is unknown and has probability 1.
    Ids are whole numbers or null; repeated rows are learned as often as they
    stand; other columns are not looked at; an empty table gives an empty
    result. hot_count changes the cost only.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    name = f"siftgrain_tokens_{uuid.uuid4().hex}"
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = min(MOST_BUCKETS, max(least, docs.rdd.getNumPartitions()))

    def bucketed(frame: DataFrame, table: str, mode: str = "errorifexists") -> DataFrame:
        frame.write.format("parquet").mode(mode).bucketBy(buckets, "unit").sortBy("unit").option("path", f"{shared_folder(spark)}/siftgrain/{table}").saveAsTable(table)
        return spark.table(table)

    units = bucketed(_tokenized(docs), name)
    tokens = units.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    parts = max(1, tokens // PART_TOKENS)

    def by_part(answer):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            K.settle()
            held: dict[int, list[dict]] = {}
            for b in batches:
                for r in b.to_pylist():
                    held.setdefault(r["part"], []).append(r)
            for p in sorted(held):
                rows = sorted(held.pop(p), key=lambda r: r["unit"])
                yield pa.RecordBatch.from_pylist(list(answer(rows)), schema=_schema(_ANSWERS))
            rows = None
            K.settle()

        return run

    def each(left: pa.Table, right: pa.Table) -> Iterator[tuple[_Unit, dict[int, dict[int, dict]]]]:
        K.settle()
        answers: dict[int, dict[int, dict]] = {}
        for x in right.to_pylist():
            answers.setdefault(x["level"], {})[x["part"]] = x
        for b in left.to_batches():
            for k in range(b.num_rows):
                yield _Unit(b.slice(k, 1).to_pylist()[0], parts), answers

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = list(_Unit(b.slice(k, 1).to_pylist()[0], parts).unigrams())
                yield pa.RecordBatch.from_pylist(rows, schema=_schema(_WORDS))

    stats: list[dict] = []

    def answered(asked: DataFrame, level: int, answer) -> DataFrame:
        """All answers so far, those of the level with them: back at the units' buckets, where later steps read them without a shuffle."""
        own, path = write_table(asked.repartition(max(least, parts), "part").mapInArrow(by_part(answer), _ANSWERS), "answers")
        stats.append(_stats(own, level))
        freed(spark)  # what was asked
        out = bucketed(own.repartition(buckets, "unit"), f"{name}_answers", "append")
        drop_table(spark, path)
        freed(spark)
        return out.filter("unit >= 0").drop("nr", "total", "types")

    answers = answered(units.mapInArrow(first, _WORDS), 1, lambda rows: _counted(rows, parts))
    begin = units.agg(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0

    def known(unit: _Unit, answers: dict[int, dict[int, dict]], levels: int) -> np.ndarray:
        unit.learn_unigrams(answers.get(1, {}), stats[0])
        count = unit.count
        for level in range(2, levels + 1):
            unit.learn(level, answers.get(level, {}), stats[level - 1], stats[level - 2], begin, hot_count)
        return count

    def ask(level: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for unit, answers in each(left, right):
                known(unit, answers, level - 1)
                rows += unit.ask(begin, hot_count)
            return pa.Table.from_pylist(rows, schema=_schema(_ENTRIES))

        return run

    for level in range(2, order + 1):
        asked = units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(ask(level), _ENTRIES)
        answers = answered(asked, level, lambda rows, level=level: _reduced(rows, level, stats[level - 2]))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for unit, answers in each(left, right):
            count = known(unit, answers, order)
            out.append(unit.result(stats[0], count))
        return pa.concat_tables(out)

    kind = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    result, _ = write_table(units.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(score, kind), "scores")
    for table in (name, f"{name}_answers"):
        spark.sql(f"DROP TABLE {table}")
        drop_table(spark, f"{shared_folder(spark)}/siftgrain/{table}")
    return result.withColumnRenamed("id", id_col)


def _stats(answers: DataFrame, level: int) -> dict:
    """Totals of a level."""
    r = answers.filter((F.col("unit") < 0) & (F.col("level") == level)).agg(F.sum("total").alias("total"), F.sum("types").alias("types"), *[F.sum(F.col("nr")[k]).alias(f"n{k}") for k in range(LARGEST + 1)]).first()
    out = {"total": r.total or 0, "types": r.types or 0, "nr": [r[f"n{k}"] or 0 for k in range(LARGEST + 1)]}
    if level == 1:
        d, total = discounts(out["nr"]), max(1, out["total"])
        left = sum((1 - d[c]) * c * out["nr"][c - 1] for c in range(1, LARGEST + 1)) / total
        # no word seen seldom: one more count for all unknown ones
        out["scale"], out["left"] = (1.0, left) if left > 0 else (total / (total + 1), 1 / (total + 1))
        if not out["total"]:
            out["left"] = 1.0
    return out


def held_out(id_col: str):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 7, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: trigram Katz scores of all documents, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~held_out("doc_id")).alias("train"))
    out = katz_scores(docs, "train")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
