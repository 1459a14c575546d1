"""Constraints on results, as queries for the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.config import STAGES


def broken(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) of the rows for which a rule's condition isn't true."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(names).alias("rule"), F.col(key).cast("string").alias("key"))


def between01(c: str) -> Column:
    return F.col(c).isNull() | F.col(c).between(0, 1)


def eligibility(photos: DataFrame) -> DataFrame:
    """photos with reject: why a photo can't be reviewed, the first reason of five, or null.

    Columns: overall, analysis_path, analysis_ok, vector_path, vector_ok.
    """
    reason = (
        F.when(~F.coalesce(F.col("overall") == "success", F.lit(False)), "phase1_not_success")
        .when(F.coalesce("analysis_path", F.lit("")) == "", "missing_analysis_path")
        .when(~F.coalesce("analysis_ok", F.lit(False)), "analysis_unreadable")
        .when(F.col("vector_path").isNull(), "embedding_missing")
        .when(~F.coalesce("vector_ok", F.lit(False)), "embedding_unreadable")
    )
    return photos.withColumn("reject", reason)


def analysis_violations(photos: DataFrame, stages: DataFrame, dim: int) -> DataFrame:
    """Of analysed photos (source_id, vector) and stage rows (source_id, stage, status, version, config_hash): missing stages, stages without version, vectors of another size or length, values that aren't finite."""
    all_ = photos.select("source_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    missing = all_.join(stages, ["source_id", "stage"], "left_anti").select(F.concat(F.lit("stage_missing:"), "stage").alias("rule"), F.col("source_id").cast("string").alias("key"))
    by_stage = broken(stages, "source_id", {"status_known": F.col("status").isin("success", "skipped", "failed", "pending"), "version": F.col("version").isNotNull(), "config_hash": F.col("config_hash").isNotNull()})
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    vectors = broken(photos, "source_id", {"vector_size": F.size("vector") == dim, "vector_finite": ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "vector_length": F.abs(length - 1) < 1e-3})
    return missing.union(by_stage).union(vectors)


def review_violations(photos: DataFrame, sets: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, key) of all broken rules of a review.

    photos: (display_id, review_set_id, rank, recommendation, ui_initial_state, overall, similarity_to_cover);
    sets: (review_set_id, set_type, photo_count, primary_id, keep_count, challengers); expected: (display_id), the eligible photos.
    """
    one = photos.groupBy("display_id").agg(F.count("*").alias("n"))
    in_set = photos.groupBy("review_set_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("firsts"), F.max("rank").alias("last"), F.count_if(F.col("recommendation") == "keep_candidate").alias("keepers"), F.count_if(F.col("recommendation") == "alternate_keeper").alias("alternates")
    )
    held = sets.join(in_set, "review_set_id", "left")
    primary = sets.select("review_set_id", F.col("primary_id").alias("display_id")).join(photos.filter("rank = 1"), ["review_set_id", "display_id"], "left_anti")
    found = [
        broken(one, "display_id", {"photo_in_one_set": F.col("n") == 1}),
        expected.select("display_id").exceptAll(one.select("display_id")).select(F.lit("photo_missing").alias("rule"), F.col("display_id").alias("key")),
        one.select("display_id").exceptAll(expected.select("display_id")).select(F.lit("photo_unexpected").alias("rule"), F.col("display_id").alias("key")),
        primary.select(F.lit("primary_is_first").alias("rule"), F.col("review_set_id").alias("key")),
        broken(photos, "display_id", {
            "role_known": F.col("recommendation").isin("keep_candidate", "alternate_keeper", "alternate", "lower_ranked"),
            "state_fits_role": F.col("ui_initial_state") == F.when(F.col("recommendation") == "keep_candidate", "recommended_keep").when(F.col("recommendation") == "alternate_keeper", "recommended_alternate").when(F.col("recommendation") == "alternate", "user_undecided").otherwise("not_prioritized"),
            "overall_in_range": F.col("overall").between(0, 1),
            "similarity_in_range": F.col("similarity_to_cover").between(-1.000001, 1.000001),
        }),
        broken(held, "review_set_id", {
            "photo_count": F.col("photo_count") == F.col("n"),
            "one_first": F.col("firsts") == 1,
            "ranks_complete": F.col("last") == F.col("n"),
            "one_keeper": F.col("keepers") == 1,
            "alternates": F.col("alternates") == F.col("keep_count") - 1,
            "challengers_complete": F.col("challengers") == F.col("n") - 1,
            "type_known": F.col("set_type").isin("single", "near_duplicate", "similar_scene"),
            "single_is_one": (F.col("set_type") == "single") == (F.col("n") == 1),
        }),
    ]
    return reduce(DataFrame.union, found)
