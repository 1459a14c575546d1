"""Scores within a set, ranks, roles and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.functions import exprs as X
from siftgrain.operators.scoring import CATEGORIES, compare_values, ui_state

#: Weight of the base score and of each category in the score within a set.
BLEND = {"base_overall": 0.75, "technical_quality": 0.1, "face_quality": 0.05, "iqa": 0.05, "composition": 0.05}


def group_normalized(photos: DataFrame, key: str = "set_no", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """photos with n_<category>: values between the group's 10th and 90th percentile as 0 to 1.

    The percentiles are those of the photos that have the category. With at
    most one of these the values stay; without spread all are 0.5.
    """
    own = [F.when(~F.array_contains("score_missing", c), F.col(c)) for c in categories]
    held = photos.groupBy(key).agg(*[F.percentile(x, F.array(F.lit(0.1), F.lit(0.9))).alias(f"p_{c}") for x, c in zip(own, categories, strict=True)], *[F.count(x).alias(f"k_{c}") for x, c in zip(own, categories, strict=True)])
    out = photos.join(held, key)
    for c in categories:
        low, high = F.col(f"p_{c}")[0], F.col(f"p_{c}")[1]
        value = F.when(F.col(f"k_{c}") <= 1, F.col(c)).when(F.abs(high - low) < 1e-9, 0.5).otherwise(X.clamp01((F.col(c) - low) / (high - low)))
        out = out.withColumn(f"n_{c}", value)
    return out.drop(*[f"{p}_{c}" for p in "pk" for c in categories])


def blended(photos: DataFrame) -> DataFrame:
    """photos with overall, the score within the set."""
    return photos.withColumn("overall", X.weighted([(c if c == "base_overall" else f"n_{c}", w) for c, w in BLEND.items()]))


# Why a photo is worth comparing, by code, and what a set's reasons say.
CHALLENGES = {"close_score": "综合评分接近或更高，值得对比", "better_face": "人脸质量更好，但综合评分略低", "same_scene": "视觉相似度较高，可作为对比候选"}
SINGLE = ("单张照片，无需组内对比", "建议保留该组唯一照片")
SIMILAR, MAIN, CANDIDATES, MORE = "同一时间段内视觉相似", "系统默认给出 %d 张主推荐", "该组共有 %d 张候选", "另有 %d 张质量较高的备选保留候选"


def challenge_text(reason: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in CHALLENGES.items() for x in kv])[reason]


def set_reasons(set_type: Column, photos: Column, primaries: Column, alternates: Column) -> Column:
    """Why a set is as it is, in one to four sentences."""
    said = X.texts((set_type.isNotNull(), SIMILAR))
    said = F.concat(said, F.array(F.format_string(MAIN, primaries.cast("int")), F.format_string(CANDIDATES, photos.cast("int"))))
    said = F.when(alternates > 0, F.concat(said, F.array(F.format_string(MORE, alternates.cast("int"))))).otherwise(said)
    return F.when(set_type == "single", F.array(*map(F.lit, SINGLE))).otherwise(said)


def keep_count(n: Column, config: Config) -> Column:
    wanted = F.when(n >= 9, 3).when(n >= 4, 2).otherwise(1)
    return F.greatest(F.lit(1), F.least(wanted, n, F.lit(config.max_keep)))


def ranked(photos: DataFrame, config: Config, key: str = "set_no", score: str = "overall", name: str = "display_id") -> DataFrame:
    """photos with rank, keep_count, recommendation and ui_initial_state."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), name)
    out = photos.withColumn("rank", F.row_number().over(order)).withColumn("keep_count", keep_count(F.count("*").over(Window.partitionBy(key)), config))
    role = (
        F.when(F.col("rank") == 1, "keep_candidate")
        .when(F.col("rank") <= F.col("keep_count"), "alternate_keeper")
        .when(F.col("rank") <= F.col("keep_count") + config.queue_size, "alternate")
        .otherwise("lower_ranked")
    )
    return out.withColumn("recommendation", role).withColumn("ui_initial_state", ui_state("recommendation"))


def challenger_queue(photos: DataFrame, key: str = "set_no") -> DataFrame:
    """(key, photo_id, rank, compare_to, is_alternate_keeper, similarity_to_primary, score_delta, reason) of all photos but the first."""
    first = photos.filter("rank = 1").select(key, F.col("display_id").alias("compare_to"), F.col("embedding").alias("_e"), F.col("overall").alias("_o"), F.col("face_quality").alias("_f"))
    met = photos.filter("rank > 1").join(first, key)
    reason = F.when(F.col("overall") >= F.col("_o"), "close_score").when(F.col("face_quality") > F.col("_f"), "better_face").otherwise("same_scene")
    return met.select(
        key,
        F.col("display_id").alias("photo_id"),
        (F.col("rank") - 1).alias("rank"),
        "compare_to",
        (F.col("recommendation") == "alternate_keeper").alias("is_alternate_keeper"),
        X.cosine("embedding", "_e").alias("similarity_to_primary"),
        (F.col("overall") - F.col("_o")).alias("score_delta"),
        reason.alias("reason"),
    )


# What sets a keeper apart from the other keepers.
ONLY_KEEPER, APART, ALIKE = "该组首选 keeper", "与其他推荐图有一定差异", "与其他推荐图较相似，但质量排名靠前"


def keeper_slots(photos: DataFrame, key: str = "set_no") -> DataFrame:
    """(key, slot_id, keeper_photo_id, rank, confidence, reasons, weaknesses, diversity) of the keeper of each set.

    photos: ranked ones with reasons and weaknesses. The one slot is the first photo's; alternates have none.
    """
    own = photos.filter("rank = 1")
    return own.select(key, F.lit("slot_1").alias("slot_id"), F.col("display_id").alias("keeper_photo_id"), F.lit(1).alias("rank"), F.round("overall", 6).alias("confidence"), "reasons", "weaknesses", diversity(F.lit(None).cast("double")).alias("diversity"))


def diversity(nearest: Column) -> Column:
    """What sets a keeper apart, by its greatest similarity to another keeper; null where it is the only one."""
    return F.when(nearest.isNull(), ONLY_KEEPER).when(nearest < 0.95, APART).otherwise(ALIKE)


def challenger_meta(photos: DataFrame, queue: DataFrame, key: str = "set_no") -> DataFrame:
    """photos with the columns of their row in the challenger queue, null where a photo has none."""
    own = queue.select(key, F.col("photo_id").alias("display_id"), F.col("rank").alias("queue_rank"), "compare_to", "similarity_to_primary", "score_delta", "reason")
    return photos.join(own, [key, "display_id"], "left")


def slot_queue(photos: DataFrame, config: Config, key: str = "set_no") -> DataFrame:
    """For each keeper slot (the first photo's) the queue_size photos most like it."""
    queue = challenger_queue(photos, key).withColumnRenamed("rank", "queue_rank")
    queue = queue.join(photos.select(key, F.col("display_id").alias("photo_id"), "overall"), [key, "photo_id"])
    order = Window.partitionBy(key).orderBy(F.col("similarity_to_primary").desc(), F.col("overall").desc(), "photo_id")
    return queue.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= config.queue_size).select(key, F.lit("slot_1").alias("slot_id"), "photo_id", "rank", F.col("similarity_to_primary").alias("similarity_to_keeper"), "score_delta", "reason")


def photo_payload(photos: DataFrame, key: str = "set_no") -> DataFrame:
    """Ranked photos with similarity_to_cover, compare_values and whether they have foreground and background vectors."""
    cover = photos.filter("rank = 1").select(key, X.l2_normalize("embedding").alias("_cover"))
    out = compare_values(photos).join(cover, key).withColumn("similarity_to_cover", F.round(X.dot(X.l2_normalize("embedding"), "_cover"), 6))
    return out.withColumns({"has_foreground_embedding": F.col("fg").isNotNull(), "has_background_embedding": F.col("bg").isNotNull()}).drop("_cover")


def keepers_in_order(photos: DataFrame, key: str = "set_no") -> DataFrame:
    """(key, keeper_ids): the given keepers of each set, the primary one first, then by rank."""
    held = photos.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "display_id"))).alias("k"))
    return held.select(key, F.transform("k", lambda x: x["display_id"]).alias("keeper_ids"))


def in_keeper_order(photos: DataFrame, primary: str = "primary_id") -> DataFrame:
    """Keepers, the primary one first, then by rank."""
    return photos.orderBy((F.col("display_id") == F.col(primary)).desc(), "rank", "display_id")
