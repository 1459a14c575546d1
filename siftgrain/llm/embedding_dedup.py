"""Operator 3: near-duplicate embeddings by random-hyperplane sign hashing.

Every vector gets a code of `bits` signs in each of several tables. Vectors that
share a code in a table are compared exactly, by cosine in double precision. The
number of bits grows with the logarithm of the number of vectors, so that a code
holds few unlike ones, and the number of tables follows from the recall asked
for at the threshold.

Equal vectors are one class before hashing. The members of a code are compared
block by block, each block pair a unit of its own, so that a code with very many
members is spread over tasks; what leaves a unit is a count for each member and
a spanning forest of its links, never its pairs. A pair that shares codes in
several tables is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.operators.components import components
from siftgrain.llm.store import drop_table, small_batches, write_table

#: Members of one code that are compared at a time.
BLOCK = 512
#: Seeds the hyperplanes.
SEED = 7


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Bits of a code and number of tables for n vectors: of pairs at the threshold, the share `recall` is found."""
    bits = max(6, ceil(log2(max(2, n))) + 2)
    same = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - same)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    """Hyperplanes of all tables, drawn from a fixed seed."""
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def codes(unit: np.ndarray, plane: np.ndarray, bits: int) -> np.ndarray:
    """The code of each row in each table."""
    signs = (unit @ plane > 0).reshape(len(unit), -1, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.cast(pa.float64())
    flat = values.to_numpy(zero_copy_only=False)
    missing = column.is_null().to_numpy(zero_copy_only=False)
    for k, none in enumerate(missing):
        v = flat[offsets[k] : offsets[k + 1]].astype(np.float64)
        norm = np.sqrt((v * v).sum()) if not none and np.isfinite(v).all() and len(v) else 0.0
        if norm == np.inf or 0 < norm < 1e-150:
            v = v / np.abs(v).max()
            norm = np.sqrt((v * v).sum())
        out.append(v / norm if norm > 0 else None)
    return out


def _prepared(df: DataFrame) -> DataFrame:
    """(id, digest of the vector or null, unit vector or null) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            units = _vectors(batch.column(1))
            digest = pa.array([None if u is None else blake2b(u.tobytes(), digest_size=16).digest() for u in units], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, pa.array(units, pa.list_(pa.float64()))], names=["id", "digest", "unit"])

    return df.mapInArrow(run, "id long, digest binary, unit array<double>")


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(rep, dim, table, code) of each class in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(1)
            dims = np.diff(np.asarray(lists.offsets))
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in plane:
                    plane[dim] = planes(dim, bits, tables)
                for k in range(0, len(rows), 2048):
                    part = rows[k : k + 2048]
                    unit = np.array(lists.take(pa.array(part)).values).reshape(len(part), dim)
                    code = codes(unit, plane[dim], bits)
                    rep = np.asarray(batch.column(0))[part]
                    n = len(part) * tables
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(rep, tables)), pa.array(np.full(n, dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(part))), pa.array(code.ravel())],
                        names=["rep", "dim", "tab", "code"],
                    )

    return classes.select("rep", "unit").mapInArrow(run, "rep long, dim int, tab int, code long")


def _compared(units: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """For the members of each block pair: (a, b, links): a count of a's links where b is null, a link of the forest elsewhere."""

    def unit_of(tab: int, own: np.ndarray, copies: np.ndarray, side: np.ndarray, vectors: np.ndarray, plane: np.ndarray):
        left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        near = vectors[left] @ vectors[right].T >= threshold
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        keep = own[i] < own[j] if (side == 0).all() else own[i] != own[j]
        i, j = i[keep], j[keep]
        if tab and len(i):  # pairs that an earlier table has brought together count there
            at, back = np.unique(np.concatenate([i, j]), return_inverse=True)
            code = codes(vectors[at], plane[:, : tab * bits], bits)
            first = np.ones(len(i), bool)
            for k in range(0, len(i), 1 << 14):
                part = slice(k, k + (1 << 14))
                first[part] = ~(code[back[: len(i)][part]] == code[back[len(i) :][part]]).any(1)
            i, j = i[first], j[first]
        links = np.bincount(i, copies[j], len(own)) + np.bincount(j, copies[i], len(own))
        root = np.arange(len(own))
        while len(i):
            least = root.copy()
            np.minimum.at(least, root[i], root[j])
            np.minimum.at(least, root[j], root[i])
            least = least[least]
            new = least[root]
            if (new == root).all():
                break
            root = new
        return links.astype(np.int64), root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane: dict[int, np.ndarray] = {}
        table = pa.Table.from_batches(batches)
        if not table.num_rows:
            return
        names = ("dim", "tab", "code", "x", "y", "side", "rep", "copies")
        col = {n: table.column(n).to_numpy() for n in names}
        order = np.lexsort([col[n] for n in ("rep", "y", "x", "code", "tab", "dim")])
        lists = table.column("unit").combine_chunks()
        offsets, flat = np.asarray(lists.offsets).astype(np.int64), np.asarray(lists.values)
        change = np.zeros(len(order), bool)
        change[0] = True
        for n in ("dim", "tab", "code", "x", "y"):
            change[1:] |= col[n][order][1:] != col[n][order][:-1]
        at = np.append(np.flatnonzero(change), len(order))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = order[a:b]
            dim, tab = int(col["dim"][rows[0]]), int(col["tab"][rows[0]])
            if dim not in plane:
                plane[dim] = planes(dim, bits, tables)
            vectors = flat[offsets[rows][:, None] + np.arange(dim)]
            own = col["rep"][rows]
            links, root = unit_of(tab, own, col["copies"][rows], col["side"][rows], vectors, plane[dim])
            some, far = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rows)))
            if len(some):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([own[some], own[far]])),
                        pa.array(np.concatenate([own[some], own[root[far]]]), mask=np.concatenate([np.ones(len(some), bool), np.zeros(len(far), bool)])),
                        pa.array(np.concatenate([links[some], np.zeros(len(far), np.int64)])),
                    ],
                    names=["a", "b", "links"],
                )

    return units.mapInArrow(run, "a long, b long, links long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, recall: float = 0.99) -> DataFrame:
    """One row for each row of df: id, n_links, component_id and kept.

    n_links counts the other rows whose vector was found and has a cosine of at
    least the threshold; component_id is the least id that links lead to; kept
    says whether that is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite values link with nothing, nor do vectors of
    different length. Rows of equal vectors link with each other. A row with a
    null id is a row, but its component is null and no component is named by
    it. Other columns are not looked at. An empty table gives an empty result.
    """
    small_batches(df.sparkSession)
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    table, path = write_table(_prepared(rows), "vectors")
    valid = table.filter("digest IS NOT NULL AND id IS NOT NULL")
    classes, classes_path = write_table(valid.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "classes")
    bits, tables = plan_tables(classes.count(), threshold, recall)

    index = _hashed(classes, bits, tables)
    index, index_path = write_table(index, "codes")
    code = ["dim", "tab", "code"]
    held = index.groupBy(*code).agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    member = index.join(held, code).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a member of block i goes to the block pairs (i, j) for j >= i and (j, i) for j < i
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = member.withColumn("other", other).select(
        *code, "rep", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("side")
    )
    units = spread.join(classes.select("rep", "copies", "unit"), "rep")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), classes.count() * tables // 200_000)
    found, found_path = write_table(_compared(units.repartition(n, *code, "x", "y"), bits, tables, threshold), "compared")

    links = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    label = components(found.filter("b IS NOT NULL")).toDF("rep", "label")
    named = classes.select("digest", "rep", "copies").join(links, "rep", "left").join(label, "rep", "left")
    out = table.select("id", "digest").join(named, "digest", "left")
    component = F.coalesce("label", "rep", "id")
    result = out.select(
        F.col("id").alias(id_col),
        F.when(F.col("rep").isNull() | F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), component).alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
    result, _ = write_table(result, "near-vectors")
    for p in (path, classes_path, index_path, found_path):
        drop_table(spark, p)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: near-duplicates of all embeddings at a cosine of 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
links AS (SELECT a AS vec_id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN links USING (vec_id)
"""
