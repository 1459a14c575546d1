"""Operator 2: benchmark decontamination by a distributed positional inverted index.

The items' terms are counted in the whole corpus. Each window of an item has an
anchor: its rarest term. The index stores postings (term, document, positions)
of every item term that stands within a window's length of an anchor's
occurrence, which is all that a match can be made of. Lists are intersected from
the rarest term of a window on, with positions less the term's offset, until all
terms are met. The same index answers proximity queries: all of a window's terms
within a span, in any order (`near_matches`).

The windows come in blocks of about BLOCK_WINDOWS, so that what is sent to the
tasks is bounded; each block is a pass over the corpus. For many sets of items,
`write_index` stores the postings of all words once, and `search_index` reads
only those of an item's words. Words meet by hash and are held against the bytes
of the item's word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftgrain.llm import kernels as K
from siftgrain.llm.store import drop_table, small_batches, write_table

#: Windows of a block of items.
BLOCK_WINDOWS = 200_000
_U64 = np.uint64


class _Words(NamedTuple):
    """The words of rows i to j of a batch: lower-cased bytes, hashes, starts and ends, and each row's first word."""

    i: int
    j: int
    data: np.ndarray
    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _tokens(column: pa.Array) -> Iterator[_Words]:
    data, start, end = K.text_bytes(column)
    for i, j in K.chunks(start, end):
        own, at = K.gather(data, start[i:j], end[i:j])
        own = K.LOWER[own]
        yield _Words(i, j, own, *K.word_hashes(own, at, K.ALNUM))


@dataclass(frozen=True)
class Terms:
    """Item words by hash, ascending, with the bytes of each."""

    hashes: np.ndarray
    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, words: list[bytes]) -> Terms:
        order = np.argsort(hashes)
        hashes = hashes[order]
        if len(hashes) and (hashes[1:] == hashes[:-1]).any():
            raise ValueError("two item words have the same 64-bit hash")  # by chance: once in 2**64 pairs
        held = [words[k] for k in order.tolist()]
        return cls(hashes, np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in held] + [0])])[: len(held) + 1].astype(np.int64))

    def find(self, w: _Words) -> np.ndarray:
        """Each word's place among the terms, or -1."""
        out = np.full(len(w.h), -1)
        if not len(self.hashes):
            return out
        likely = np.flatnonzero(_filter(self.hashes)[(w.h >> _U64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, w.h[likely]), len(self.hashes) - 1)
        hit = (self.hashes[at] == w.h[likely]) & (np.diff(self.at)[at] == (w.end - w.start)[likely])
        likely, at = likely[hit], at[hit]
        own = ~K.differ(w.data, w.start[likely], self.at[at], (w.end - w.start)[likely], self.data)
        out[likely[own]] = at[own]
        return out


def _long(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def item_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(item string, window long, terms array<long>): distinct windows of n words of the items; a shorter item is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, h, _, _, first in _tokens(batch.column(1)):
                rows, terms = [], []
                for k in range(j - i):
                    own = h[first[k] : first[k + 1]]
                    size = min(n, len(own))
                    for at in range(len(own) - size + 1 if size else 0):
                        rows.append(i + k)
                        terms.append(_long(own[at : at + size]))
                flat = K.lists(np.concatenate(terms) if terms else np.zeros(0, np.int64), np.array([len(t) for t in terms], np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), flat], names=["item", "terms"])

    kind = "item string, terms array<long>"
    out = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col)).mapInArrow(run, kind)
    return out.distinct().select("item", F.xxhash64("terms").alias("window"), "terms")


def item_words(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term long, word binary): the items' distinct words by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _tokens(batch.column(0)):
                sample, _ = K.distinct_spans(w.data, w.start, w.end)
                raw = w.data.tobytes()
                own = [raw[a:b] for a, b in zip(w.start[sample].tolist(), w.end[sample].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_long(w.h[sample])), pa.array(own, pa.binary())], names=["term", "word"])

    return items.filter(F.col(id_col).isNotNull()).select(text_col).mapInArrow(run, "term long, word binary").distinct()


def term_counts(docs: DataFrame, terms: Terms) -> np.ndarray:
    """How often each of the terms (a bounded number) stands in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total = np.zeros(len(own.hashes), np.int64)
        for batch in batches:
            for w in _tokens(batch.column(0)):
                at = own.find(w)
                total += np.bincount(at[at >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    found = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms.hashes), np.int64)
    out[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return out


_FILTERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _filter(own: np.ndarray) -> np.ndarray:
    """Which values of the upper 20 bits the terms have."""
    known = _FILTERS.get(id(own))
    if known is None or known[0] is not own:
        table = np.zeros(1 << 20, bool)
        table[(own >> _U64(44)).astype(np.int64)] = True
        _FILTERS.clear()
        known = _FILTERS[id(own)] = (own, table)
    return known[1]


def positional_index(docs: DataFrame, terms: Terms, anchors: np.ndarray, reach: int) -> DataFrame:
    """(key, n_words, lists array<struct<term, positions array<int>>>): of each document the terms that stand at most `reach` words from an anchor.

    anchors: the hashes of those terms that are one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((terms, np.isin(terms.hashes, anchors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, is_anchor = shared.value
        for batch in batches:
            for w in _tokens(batch.column(1)):
                i, j, h, first = w.i, w.j, w.h, w.first
                at = own.find(w)
                places = np.flatnonzero(at >= 0)
                row = np.searchsorted(first, places, side="right") - 1
                anchor = places[is_anchor[at[places]]] if len(places) else places
                near = np.zeros(len(h) + 1, np.int32)
                a_row = np.searchsorted(first, anchor, side="right") - 1
                np.add.at(near, np.maximum(anchor - reach, first[a_row]), 1)
                np.add.at(near, np.minimum(anchor + reach + 1, first[a_row + 1]), -1)
                keep = np.cumsum(near[:-1])[places] > 0 if len(places) else np.zeros(0, bool)
                places, row = places[keep], row[keep]
                term = at[places]
                order = np.lexsort((places, term, row))
                places, row, term = places[order], row[order], term[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
                n_lists = np.bincount(row[new], minlength=j - i)
                lists = K.lists((places - first[row]).astype(np.int32), np.diff(np.append(new, len(row))) if len(row) else new)
                both = pa.StructArray.from_arrays([pa.array(_long(own.hashes[term[new]]) if len(new) else np.zeros(0, np.int64)), lists], names=["term", "positions"])
                at_row = pa.array(np.concatenate([[0], np.cumsum(n_lists)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(at_row, both)], names=["key", "n_words", "lists"])

    kind = f"key {docs.schema['key'].dataType.simpleString()}, n_words long, lists array<struct<term: long, positions: array<int>>>"
    return docs.select("key", "text").mapInArrow(run, kind)


def _matches(postings: DataFrame, plan: DataFrame, n_terms: DataFrame) -> DataFrame:
    """(window, key, at): where all terms of a window stand at their offsets.

    plan: (window, rank, term, offset), rank 0 the rarest. Candidates come from
    the rarest term's list; each list after it is asked only for the places
    that the candidates need, the second first.
    """
    rarest = plan.filter("rank = 0").select("window", "term", "offset")
    start = postings.join(F.broadcast(rarest), "term").select("window", "key", F.explode("positions").alias("p"), "offset")
    start = start.select("window", "key", (F.col("p") - F.col("offset")).alias("at")).filter("at >= 0").distinct()
    places = postings.select("key", "term", F.explode("positions").alias("p"))

    def met(candidates: DataFrame, ranks: str) -> DataFrame:
        """(window, key, at, met): how many of the ranks' terms stand where a candidate needs them."""
        needed = candidates.join(F.broadcast(plan.filter(ranks)), "window").withColumn("p", F.col("at") + F.col("offset"))
        return needed.join(places, ["key", "term", "p"], "left_semi").groupBy("window", "key", "at").agg(F.count("*").alias("met"))

    single = F.broadcast(n_terms.filter("n = 1").select("window"))
    second = met(start, "rank = 1").drop("met").union(start.join(single, "window", "left_semi"))
    whole = second.join(met(second, "rank >= 2"), ["window", "key", "at"], "left").join(F.broadcast(n_terms), "window")
    return whole.filter(F.coalesce("met", F.lit(0)) == F.greatest(F.col("n") - 2, F.lit(0))).select("window", "key", "at", "n")


def proximity(postings: DataFrame, plan: DataFrame, n_terms: DataFrame, slop: int) -> DataFrame:
    """(window, key, first, last): least spans of at most slop words more than the window has that hold all of its distinct terms, in any order.

    A least span holds no smaller one. Candidates are the occurrences of the
    window's rarest term that have the second rarest one near; places meet by
    stretches of a span's length, so that only what is near is compared.
    """
    terms = plan.groupBy("window", "term").agg(F.min("rank").alias("rank")).join(n_terms, "window").withColumn("wide", F.col("n") + slop).drop("n")
    by_rank = Window.partitionBy("window").orderBy("rank")
    terms = terms.withColumn("rank", F.row_number().over(by_rank) - 1)
    distinct = terms.groupBy("window").agg(F.count("*").alias("terms"))
    spot = ["window", "key", "anchor"]

    def places(ranks: str) -> DataFrame:
        own = postings.join(F.broadcast(terms.filter(ranks)), "term")
        return own.select("window", "key", "term", "wide", F.explode("positions").alias("p")).withColumn("stretch", F.expr("p div wide"))

    def near(anchors: DataFrame, ranks: str) -> DataFrame:
        around = anchors.withColumn("stretch", F.explode(F.expr("sequence(anchor div wide - 1, anchor div wide + 1)"))).drop("wide")
        return around.join(places(ranks), ["window", "key", "stretch"]).filter(F.abs(F.col("p") - F.col("anchor")) < F.col("wide")).select(*spot, "term", "p", "wide")

    rare = places("rank = 0").select("window", "key", F.col("p").alias("anchor"), "wide")
    alone = F.broadcast(distinct.filter("terms = 1").select("window"))
    some = near(rare, "rank = 1").select(*spot, "wide").distinct().union(rare.join(alone, "window", "left_semi").select(*spot, "wide"))
    held = near(some, "rank >= 0")
    # a span that holds the anchor begins at one of the places at or before it
    begins = held.filter("p <= anchor").select(*spot, F.col("p").alias("first")).distinct()
    inside = begins.join(held, spot).filter((F.col("p") >= F.col("first")) & (F.col("p") < F.col("first") + F.col("wide")))
    firsts = inside.groupBy("window", "key", "first", "term").agg(F.min("p").alias("p"))
    spans = firsts.groupBy("window", "key", "first").agg(F.max("p").alias("last"), F.count("*").alias("met")).join(F.broadcast(distinct), "window")
    spans = spans.filter("met = terms").select("window", "key", "first", "last")
    return spans.groupBy("window", "key", "last").agg(F.max("first").alias("first")).select("window", "key", "first", "last")


def _plan(spark: SparkSession, windows: DataFrame, terms: Terms, counts: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(window, rank, term, offset) by the terms' rarity, of the windows whose terms all occur, and the anchors' hashes."""
    own = windows.select("window", "terms").dropDuplicates(["window"]).toArrow()
    lists = own.column("terms").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size, flat = np.diff(np.asarray(lists.offsets)).astype(np.int64), np.asarray(lists.flatten()).view(_U64)
    window, offset = np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    n = counts[np.searchsorted(terms.hashes, flat)] if len(flat) else np.zeros(0, np.int64)
    met = np.ones(len(size), bool)
    met[window[n == 0]] = False
    order = np.lexsort((offset, n, window))
    rank = offset  # the windows' entries lie together in both orders
    keep = met[window[order]]
    order, rank = order[keep], rank[keep]
    names = own.column("window").to_numpy()
    rows = pa.table({"window": pa.array(names[window[order]]), "rank": pa.array(rank.astype(np.int32)), "term": pa.array(_long(flat[order])), "offset": pa.array(offset[order].astype(np.int32))})
    return spark.createDataFrame(rows), np.unique(flat[order[rank == 0]])


def _blocks(docs: DataFrame, items: DataFrame, n: int, slop: int, item_id_col: str, item_text_col: str) -> Iterator[tuple[DataFrame, DataFrame, DataFrame, DataFrame, list[str]]]:
    """(windows, plan, index, sizes of the windows, tables to drop) of each block of windows."""
    spark = docs.sparkSession
    windows, path = write_table(item_windows(items, n, item_id_col, item_text_col), "windows")
    words, words_path = write_table(item_words(items, item_id_col, item_text_col), "item-words")
    blocks = -(-max(1, windows.count()) // BLOCK_WINDOWS)
    for block in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        found = words.join(own.select(F.explode("terms").alias("term")).distinct(), "term").toArrow()
        terms = Terms.of(found.column("term").to_numpy().view(_U64), found.column("word").to_pylist())
        plan, anchors = _plan(spark, own, terms, term_counts(docs, terms))
        index, index_path = write_table(positional_index(docs, terms, anchors, n - 1 + slop), "postings")
        yield own, plan, index, plan.groupBy("window").agg(F.count("*").alias("n")), [path, words_path, index_path]


def _postings(index: DataFrame) -> DataFrame:
    return index.filter(F.size("lists") > 0).select("key", F.explode("lists").alias("x")).select("key", "x.term", "x.positions")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): rows of equal id and text are alike in all that follows."""
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest")).alias("key"), F.col(text_col).alias("text"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10, by_row: bool = False) -> DataFrame:
    """For each row of docs: id, n_words, n_hit, items array<string> (ascending), contaminated.

    Words are runs of lower-cased letters, digits and all beyond ASCII. A
    window is n successive words of an item, or all of an item of fewer; an item
    without words has none. A document's word is hit when it lies in an
    occurrence of a window. A null text has no words; rows with a null id, and
    repeated rows, are rows of their own; items with a null id or text are left
    out; other columns are not looked at. Empty documents give an empty result;
    without items nothing is hit. by_row: with digest, xxhash64 of the text.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    hits, words, paths = None, None, []
    for own, plan, index, sizes, used in _blocks(_keyed(docs, id_col, text_col), items, n, 0, item_id_col, item_text_col):
        found, path = write_table(_matches(_postings(index), plan, sizes), "matches")
        paths += [path, *used]
        met = found.join(F.broadcast(own.select("window", "item")), "window").select("key", "at", "n", "item")
        hits = met if hits is None else hits.union(met)
        words = words if words is not None else index.select("key", "n_words")
    result, _ = write_table(_summary(words, hits, id_col, by_row), "contamination")
    for path in dict.fromkeys(paths):
        drop_table(spark, path)
    return result


def near_matches(docs: DataFrame, items: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """(id, item, first, last): where all distinct words of a window of an item stand within n + slop words, in any order.

    first and last are the places of a least span's words, from 0; windows and
    words as in `contamination`. Equal rows of docs give one set of spans; null
    texts, and items with a null id or text, give none.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    out, paths = None, []
    for own, plan, index, sizes, used in _blocks(_keyed(docs, id_col, text_col), items, n, slop, item_id_col, item_text_col):
        found = proximity(_postings(index).distinct(), plan, sizes, slop).join(F.broadcast(own.select("window", "item")), "window")
        met, _ = write_table(found.select(F.col("key.id").alias(id_col), "item", "first", "last"), "near")
        paths += used
        out = met if out is None else out.union(met)
    for path in dict.fromkeys(paths):
        drop_table(spark, path)
    return out.distinct()


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the postings (word binary, key, positions array<int>) of all words at path/postings, by word and key, and (key, n_words) at path/documents.

    Ranges of word and key are dealt out, so that the postings of a frequent word are in many files, and few files hold a given rare one.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _tokens(batch.column(1)):
                sample, word = K.distinct_spans(w.data, w.start, w.end)
                row = np.repeat(np.arange(w.j - w.i), np.diff(w.first))
                order = np.lexsort((word, row))
                new = np.flatnonzero(np.concatenate([[True], (np.diff(row[order]) != 0) | (np.diff(word[order]) != 0)])) if len(order) else order
                head = order[new]
                raw = w.data.tobytes()
                words = pa.array([raw[w.start[k] : w.end[k]] for k in head.tolist()], pa.binary())
                lists = K.lists((order - w.first[row[order]]).astype(np.int32), np.diff(np.append(new, len(order))))
                yield pa.RecordBatch.from_arrays([words, batch.column(0).take(pa.array(row[head] + w.i)), lists], names=["word", "key", "positions"])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in _tokens(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.i, w.j - w.i), pa.array(np.diff(w.first).astype(np.int64))], names=["key", "n_words"])

    posted = keyed.dropDuplicates(["key"]).mapInArrow(run, f"word binary, key {kind}, positions array<int>")
    posted.repartitionByRange("word", "key").sortWithinPartitions("word", "key").write.parquet(f"{path}/postings")
    keyed.mapInArrow(sizes, f"key {kind}, n_words long").write.parquet(f"{path}/documents")


def search_index(spark: SparkSession, path: str, items: DataFrame, id_col: str = "doc_id", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 10) -> DataFrame:
    """As `contamination`, over the postings that write_index stored. Only those of the items' words are read."""
    small_batches(spark)
    windows, windows_path = write_table(item_windows(items, n, item_id_col, item_text_col), "windows")
    words, words_path = write_table(item_words(items, item_id_col, item_text_col), "item-words")
    stored, documents = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/documents")
    blocks = -(-max(1, windows.count()) // BLOCK_WINDOWS)
    hits, paths = None, [windows_path, words_path]
    for block in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        wanted = words.join(own.select(F.explode("terms").alias("term")).distinct(), "term")
        found = wanted.toArrow()
        terms = Terms.of(found.column("term").to_numpy().view(_U64), found.column("word").to_pylist())
        postings = stored.join(F.broadcast(wanted), "word").select("key", "term", "positions")
        counted = postings.groupBy("term").agg(F.sum(F.size("positions")).cast("long").alias("n")).toArrow()
        counts = np.zeros(len(terms.hashes), np.int64)
        counts[np.searchsorted(terms.hashes, counted.column("term").to_numpy().view(_U64))] = counted.column("n").to_numpy()
        plan, _ = _plan(spark, own, terms, counts)
        sizes = plan.groupBy("window").agg(F.count("*").alias("n"))
        met, met_path = write_table(_matches(postings, plan, sizes).join(F.broadcast(own.select("window", "item")), "window").select("key", "at", "n", "item"), "matches")
        paths.append(met_path)
        hits = met if hits is None else hits.union(met)
    result, _ = write_table(_summary(documents, hits, id_col), "contamination")
    for p in paths:
        drop_table(spark, p)
    return result


def _summary(words: DataFrame, hits: DataFrame, id_col: str, by_row: bool = False) -> DataFrame:
    spans = hits.select("key", "at", (F.col("at") + F.col("n")).alias("end")).groupBy("key", "at").agg(F.max("end").alias("end"))
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # of each span the words that no earlier one has
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("at"), F.coalesce(F.max("end").over(before), F.col("at"))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    items = hits.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = words.join(n_hit.join(items, "key"), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("key.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), *([F.col("key.digest").alias("digest")] if by_row else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents with windows of 10 words of a benchmark item."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), met AS (SELECT doc_id, item_id, windows.n, i FROM grams JOIN windows USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
