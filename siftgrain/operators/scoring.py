"""Quality scores of single photos, and what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.functions import exprs as X

#: Metrics of a photo as columns; all may be null.
METRICS = (
    "laplacian_var", "shadow_clip", "highlight_clip", "brightness_mean", "contrast_std_ratio", "dynamic_range",
    "saturation_mean", "color_cast", "piqe", "aesthetic", "center_sharpness_ratio", "center_brightness_delta", "aspect_ratio",
)
CATEGORIES = ("technical_quality", "face_quality", "iqa", "composition")

# Reasons by badge, weaknesses by warning, and what stands where there are none.
REASONS = {"technical_good": "技术质量较好", "face_good": "人脸质量较好", "iqa_good": "IQA 质量分较好"}
WEAKNESSES = {"highlight_clip": "高光裁切偏多", "shadow_clip": "暗部裁切偏多", "underexposed": "整体亮度偏暗", "overexposed": "整体亮度偏亮"}
NO_REASON, NO_WEAKNESS, MISSING = "组内综合评分可用", "暂无明显弱点", "缺少 %s 数据"


def largest_face(faces: str) -> Column:
    """The face with the greatest area_ratio, the first of equal ones; null without faces."""
    larger = lambda best, x: F.when(X.finite(x["area_ratio"], 0.0) > X.finite(best["area_ratio"], 0.0), x).otherwise(best)
    return F.when(F.size(faces) > 0, F.aggregate(faces, F.try_element_at(faces, F.lit(1)), larger))


def scored(photos: DataFrame) -> DataFrame:
    """photos with technical_quality, face_quality, iqa, composition, base_overall and score_missing.

    photos has the columns METRICS, face_count and face struct<area_ratio,
    sharpness, alignment, confidence> (the largest one, or null), and
    has_metrics: whether none of the metric groups is empty.
    """
    m = {c: X.finite(c) for c in METRICS}
    bright = F.coalesce(m["brightness_mean"], F.lit(127.5))
    technical = X.weighted([
        (X.log_ratio("laplacian_var", 800), 0.35),
        (1 - 8 * F.coalesce(m["shadow_clip"], F.lit(0.0)) - 10 * F.coalesce(m["highlight_clip"], F.lit(0.0)), 0.2),
        (1 - F.abs(bright - 127.5) / 127.5, 0.1),
        (F.coalesce(m["contrast_std_ratio"], F.lit(0.0)) / 0.22, 0.15),
        (F.coalesce(m["dynamic_range"], F.lit(0.0)) / 0.45, 0.1),
        (1 - F.abs(F.coalesce(m["saturation_mean"], F.lit(0.35)) - 0.35) / 0.45 - 1.5 * F.coalesce(m["color_cast"], F.lit(0.0)), 0.1),
    ])
    has_face = F.col("face").isNotNull() & (F.col("face_count") > 0)
    face = X.weighted([
        (X.log_ratio(F.col("face.sharpness"), 900), 0.4),
        (X.finite(F.col("face.area_ratio"), 0.0) / 0.04, 0.25),
        (X.finite(F.col("face.alignment"), 0.0), 0.2),
        (X.finite(F.col("face.confidence"), 0.0), 0.15),
    ])
    piqe, aesthetic = X.clamp01(1 - m["piqe"] / 100), X.clamp01(m["aesthetic"])
    has_piqe, has_aesthetic = m["piqe"].isNotNull(), m["aesthetic"].isNotNull()
    iqa = F.when(has_piqe & has_aesthetic, X.weighted([(piqe, 0.7), (aesthetic, 0.3)])).when(has_piqe, piqe).when(has_aesthetic, aesthetic)
    aspect = F.abs(F.coalesce(m["aspect_ratio"], F.lit(1.5)) - 1.5)
    composition = X.weighted([
        (F.coalesce(m["center_sharpness_ratio"], F.lit(1.0)) / 1.5, 0.45),
        (1 - 2 * F.abs(F.coalesce(m["center_brightness_delta"], F.lit(0.0))) / 255, 0.35),
        (1 - F.greatest(F.lit(0.0), aspect - 1.2) / 2, 0.2),
    ])
    out = photos.withColumns({"technical_quality": technical, "face_quality": F.when(has_face, face).otherwise(0.5), "iqa": F.coalesce(iqa, F.lit(0.5)), "composition": composition})
    missing = X.texts(
        (~F.coalesce("has_metrics", F.lit(False)), "technical_quality"),
        (~F.coalesce(has_face, F.lit(False)), "face_quality"),
        (~has_piqe & ~has_aesthetic, "iqa"),
        (m["center_sharpness_ratio"].isNull() & m["center_brightness_delta"].isNull() & m["aspect_ratio"].isNull(), "composition"),
    )
    base = X.weighted([("technical_quality", 0.35), ("face_quality", F.when(F.col("face_count") > 0, 0.2).otherwise(0.05)), ("iqa", 0.25), ("composition", 0.2)])
    return out.withColumns({"base_overall": base, "score_missing": missing})


def explained(photos: DataFrame) -> DataFrame:
    """photos with badges and warnings (codes), and with reasons and weaknesses (texts)."""
    badges = X.texts((F.col("technical_quality") >= 0.75, "technical_good"), ((F.col("face_quality") >= 0.75) & (F.col("face_count") > 0), "face_good"), (F.col("iqa") >= 0.7, "iqa_good"))
    b = X.finite("brightness_mean")
    warnings = X.texts(
        (X.finite("highlight_clip", 0.0) > 0.03, "highlight_clip"), (X.finite("shadow_clip", 0.0) > 0.05, "shadow_clip"), (b < 70, "underexposed"), (b > 190, "overexposed")
    )
    out = photos.withColumns({"badges": badges, "warnings": warnings})
    named = lambda codes, table: F.transform(codes, lambda c: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c])
    weaknesses = F.concat(named(F.col("warnings"), WEAKNESSES), F.transform("score_missing", lambda c: F.format_string(MISSING, c)))
    fill = lambda x, d: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(d)))
    return out.withColumns({"reasons": fill(named(F.col("badges"), REASONS), NO_REASON), "weaknesses": fill(weaknesses, NO_WEAKNESS)})


def with_foreground(analysis: DataFrame) -> DataFrame:
    """analysis (image_metrics, person_mask structs) with the mask's area ratios as image_metrics.foreground; null without a mask."""
    mask = F.col("person_mask")
    own = F.struct(mask["foreground_area_ratio"].alias("foreground_area_ratio"), mask["foreground_enhanced_area_ratio"].alias("foreground_enhanced_area_ratio"), F.lit("person_mask").alias("source"))
    return analysis.withColumn("image_metrics", F.col("image_metrics").withField("foreground", F.when(mask["foreground_area_ratio"].isNotNull(), own)))


def empty_features() -> Column:
    """The frame of score features before anything is known: every category with its weight and no value."""
    weights = {"technical_quality": 0.35, "face_quality": 0.2, "iqa": 0.25, "composition": 0.2}
    return F.struct(*[F.struct(F.lit(w).alias("weight"), F.lit(None).cast("double").alias("value")).alias(c) for c, w in weights.items()])


def ui_state(recommendation: str) -> Column:
    r = F.col(recommendation)
    return F.when(r == "keep_candidate", "recommended_keep").when(r == "alternate_keeper", "recommended_alternate").when(r == "alternate", "user_undecided").otherwise("not_prioritized")


def compare_metrics(raw: list[str], normalised: list[str]) -> Column:
    """struct(values, raw): maps of the metrics that aren't null."""
    own = lambda cs: X.without_nulls(F.create_map(*[x for c in cs for x in (F.lit(c), F.col(c).cast("double"))]), 6)
    return F.struct(own(normalised).alias("values"), own(raw).alias("raw"))


def compare_values(photos: DataFrame) -> DataFrame:
    """photos (METRICS) with compare_values map<string, double>: metrics as 0 to 1, by the name that a comparison shows; absent IQA values are left out."""
    m = {c: X.finite(c) for c in METRICS}
    or_ = lambda c, d: F.coalesce(m[c], F.lit(d))
    values = {
        "sharpness": X.log_ratio("laplacian_var", 800),
        "center_sharpness": X.clamp01(or_("center_sharpness_ratio", 1.0) / 1.5),
        "exposure_clip": X.clamp01(1 - 8 * or_("shadow_clip", 0.0) - 10 * or_("highlight_clip", 0.0)),
        "brightness": X.clamp01(1 - F.abs(or_("brightness_mean", 127.5) - 127.5) / 127.5),
        "contrast": X.clamp01(or_("contrast_std_ratio", 0.0) / 0.22),
        "dynamic_range": X.clamp01(or_("dynamic_range", 0.0) / 0.45),
        "saturation": X.clamp01(1 - F.abs(or_("saturation_mean", 0.35) - 0.35) / 0.45),
        "color_cast": X.clamp01(1 - 1.5 * or_("color_cast", 0.0)),
        "piqe": F.when(m["piqe"].isNotNull(), X.clamp01(1 - m["piqe"] / 100)),
        "aesthetic": F.when(m["aesthetic"].isNotNull(), X.clamp01(m["aesthetic"])),
    }
    return photos.withColumn("compare_values", X.without_nulls(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), 6))


def metric_differences(left: str, right: str, weights: dict[str, float], limit: int | None = 5) -> Column:
    """The metrics of two maps by the weighted size of their difference, the greatest first."""
    keys = F.array(*map(F.lit, sorted(weights)))
    weight = F.create_map(*[x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(w))])
    both = F.filter(keys, lambda k: F.map_contains_key(F.col(left), k) & F.map_contains_key(F.col(right), k))
    rows = F.transform(both, lambda k: F.struct((-F.abs((F.col(left)[k] - F.col(right)[k]) * weight[k])).alias("order"), k.alias("metric"), (F.col(left)[k] - F.col(right)[k]).alias("delta")))
    out = F.transform(F.sort_array(rows), lambda x: F.struct(x["metric"], x["delta"], (-x["order"]).alias("impact")))
    return out if limit is None else F.slice(out, 1, limit)
