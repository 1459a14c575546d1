"""Summaries, top lists and small helpers of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.operators.store import write_table


def nearest_ranks(df: DataFrame, value: str, by: list[str], percents: dict[str, float]) -> DataFrame:
    """(by..., one column for each percentile): the value at place round(p / 100 * (n - 1)) of a group's sorted values, halves to even.

    Equal values are counted before they are sorted, so that a group costs what
    its distinct values do, and no task holds its rows.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy(value)
    placed = counted.withColumn("_end", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = {name: F.bround(F.lit(p) / 100 * (F.col("_all") - 1)) for name, p in percents.items()}
    return placed.groupBy(*by).agg(*[F.max(F.when((at[n] < F.col("_end")) & (at[n] >= F.col("_end") - F.col("_n")), F.col(value))).alias(n) for n in percents])


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, median, min, max, p95) of a metric."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, 0.95).alias("p95"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def throughput(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., items_per_s, ms_per_item) of rows (items, duration_ms)."""
    items, ms = F.sum("items"), F.sum("duration_ms")
    return df.groupBy(*by).agg((items / ms * 1000).alias("items_per_s"), (ms / items).alias("ms_per_item"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def last_rows(df: DataFrame, by: list[str], order: str, k: int) -> DataFrame:
    """The last k rows of each group, such as recent errors."""
    return top_per_group(df, by, [F.col(order).desc()], k)


def replicated(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, with its copy number."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def drawn(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Rows drawn with replacement."""
    return df.sample(withReplacement=True, fraction=fraction, seed=seed)


def batched(df: DataFrame, by: list[str], order: str, size: int) -> DataFrame:
    """df with batch: runs of `size` rows of each group."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("batch", F.floor((rn - 1) / size).cast("long"))


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a number from 1 by the order columns, which tell all rows apart, over the whole table.

    Rows are dealt out by ranges of the order; each range is numbered by itself,
    from where the ranges before it end. What the driver holds is one count a range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt, _ = write_table(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before, ends = 0, []
    for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        ends.append((r["_range"], before))
        before += r.n
    offsets = spark.createDataFrame(ends, "_range int, _before long")
    rn = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, rn).join(F.broadcast(offsets), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def review_summary(sets: DataFrame) -> DataFrame:
    """One row of counts over review sets (set_type, photos array<struct<recommendation>>, challenger_queue, keeper_ids)."""
    kind = lambda k: F.count_if(F.col("set_type") == k).alias(f"{k}_sets")
    role = lambda r: F.sum(F.size(F.filter("photos", lambda p: p["recommendation"] == r)))
    return sets.agg(
        F.count("*").alias("sets"),
        *[kind(k) for k in ("single", "near_duplicate", "similar_scene")],
        F.sum(F.size("photos")).alias("photos"),
        F.sum(F.size("keeper_ids")).alias("keepers"),
        role("alternate_keeper").alias("alternate_keepers"),
        F.sum(F.size("challenger_queue")).alias("challengers"),
        role("lower_ranked").alias("lower_ranked"),
    )
