"""Tables in the shared folder, and joins by id that shuffle little."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.operators.store import HOT_KEYS, drop_table, hot_count, looked_up, shared_folder, unique_names, write_table

#: Bytes of a batch of rows on its way to Python.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

#: Bits of the filter of only_ids: 2**18 words of it are broadcast, whatever the data.
FILTER_BITS = 1 << 24

__all__ = ["HOT_KEYS", "drop_table", "freed", "hot_count", "likely_ids", "looked_up", "only_ids", "shared_folder", "small_batches", "tasks", "without_ids", "write_table"]


def small_batches(spark: SparkSession) -> None:
    """From now on batches of at most BATCH_BYTES go to Python, unless the session's setting isn't the default.

    Rows hold whole texts; each task has a batch and its copies in the executor's memory outside the heap.
    """
    if spark.conf.get(_BATCH, str(_DEFAULT)).rstrip("b") == str(_DEFAULT):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def freed(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what nothing refers to any more.

    It does so when the driver collects garbage, by itself each half an hour; a
    job of several steps, each of which leaves about the input's size, can't wait for that.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)  # executors delete them meanwhile


def tasks(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions of about `each` rows, at least as many as a shuffle has by default."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // each))


def _marked(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """df with the bits of a fixed-size bitmap of the ids beside its rows, and whether a row's id may be among them."""
    word, bits, slot = unique_names(df, ["slot_word", "slot_bits", "slot"])
    at = F.pmod(F.xxhash64(id_col), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, CAST(`{slot}` % 64 AS INT))")
    words = ids.select(at.alias(slot)).groupBy(F.expr(f"`{slot}` div 64").alias(word)).agg(F.bit_or(bit).alias(bits))
    marked = df.withColumn(slot, at).withColumn(word, F.expr(f"`{slot}` div 64")).join(F.broadcast(words), word, "left")
    return marked, F.coalesce(F.col(bits).bitwiseAND(bit) != 0, F.lit(False))


def likely_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is in `ids`, and some others that a bitmap of fixed size can't tell from them; nothing of df is shuffled."""
    marked, likely = _marked(df, ids, id_col)
    return marked.filter(likely).select(*[F.col(f"`{c}`") for c in df.columns])


def only_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id is in `ids` (one column of the same name).

    A bitmap of fixed size keeps most of the other rows out of the shuffle of
    the join that decides.
    """
    # not a semi-join, which would be moved below the filter
    return likely_ids(df, ids, id_col).join(ids.distinct(), id_col)


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of df whose id isn't in `ids`; only those that the bitmap can't tell apart are shuffled. Null ids stay."""
    gone_id = unique_names(df, ["gone_id"])[0]
    gone = ids.distinct().withColumnRenamed(id_col, gone_id)
    marked, likely = _marked(df, ids, id_col)
    columns = [F.col(f"`{c}`") for c in df.columns]
    unsure = marked.filter(likely).select(*columns).join(gone, F.col(id_col) == F.col(gone_id), "left_anti")
    return marked.filter(~likely).select(*columns).union(unsure.select(*columns))
