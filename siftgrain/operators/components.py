"""Distributed connected components by alternating large and small stars.

Each round replaces the links of a vertex by links to the least vertex of its
neighbourhood; the links become stars around the components' least vertices in
a number of rounds that grows with the logarithm of the longest path. Minima
are combined before a shuffle, and the links of the few vertices that have a
large share of them get the minima by broadcast, where they are; so no task gets
all links of a vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.operators.store import drop_table, hot_count, looked_up, write_table

#: Links that one call of the local contraction holds.
LOCAL_LINKS = 1 << 18
#: Up to so many links a vertex may have all of them in one task.
FEW_LINKS = 1 << 17


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of some rows as stars around the least vertex of each of their components."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        links = np.concatenate(held, axis=1)
        held.clear()
        ids, both = np.unique(links, return_inverse=True)
        a, b = both.reshape(links.shape)
        root = np.arange(len(ids))
        while True:  # least label over links, then over labels
            least = root.copy()
            np.minimum.at(least, root[a], root[b])
            np.minimum.at(least, root[b], root[a])
            least = least[least]
            new = least[root]
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], names=["v", "u"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]))
        if sum(x.shape[1] for x in held) >= LOCAL_LINKS:
            yield out()
    if held:
        yield out()


def _with_least(links: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """links (v, u) with m of their v; least: (v, m, n), n being how many links v has."""
    if total <= FEW_LINKS:
        return links.join(least.drop("n"), "v")
    return looked_up(links, least.drop("n"), least.filter(F.col("n") >= hot_count(total)).select("v"), ["v"], "inner")


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Links (v, u) with v > u: each vertex's larger neighbours go to its least neighbour."""
    both = links.select("v", "u").union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.filter("u > v"), least, 2 * total).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Each vertex and its smaller neighbours go to the least of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
    joined = _with_least(links, least, total)
    kept = joined.filter("u != m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return kept.union(least.select("v", F.col("m").alias("u"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): for each vertex with a link to another, the least vertex that links lead to.

    Ids are whole numbers. Links may be repeated and in either order; a link of
    a vertex with itself, and one with a null end, links nothing. Without links
    the result is empty. Raises RuntimeError if max_rounds don't suffice.
    """
    spark = links.sparkSession
    clean = links.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("u")).filter("v != u")
    now, path = write_table(clean.mapInArrow(_contract, "v long, u long").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
                now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
            )
        before = state
        new, new_path = write_table(_small_star(_large_star(now, state[0]), state[0]), "links")
        drop_table(spark, path)
        now, path = new, new_path
    raise RuntimeError(f"links don't settle in {max_rounds} rounds")
