"""Names and paths of photos, and defaults of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftgrain.config import STAGES, Config
from siftgrain.functions import exprs as X

# Where a photo's artifacts are below the cache folder.
ARTIFACTS = {
    "preview": "previews/{}.jpg",
    "thumb": "thumbs/{}.jpg",
    "embedding": "embeddings/{}.npy",
    "foreground_embedding": "foreground_embeddings/{}.npy",
    "background_embedding": "background_embeddings/{}.npy",
    "person_mask": "masks/{}__person.png",
    "person_enhanced_mask": "masks/{}__person_enhanced.png",
    "foreground": "foregrounds/{}.jpg",
    "background": "backgrounds/{}.jpg",
    "analysis": "analysis/{}/analysis.json",
}


def identified(files: DataFrame) -> DataFrame:
    """files (rel_path, file_name, extension) with source_id and display_id; where several files have one display id, all get part of their source id."""
    stem = F.expr("substring(file_name, 1, length(file_name) - length(extension))")
    out = files.withColumn("source_id", X.source_id("rel_path")).withColumn("base_id", X.sanitize_display_id(stem, "extension", "file_name"))
    several = F.count("*").over(Window.partitionBy("base_id")) > 1
    return out.withColumn("display_id", F.when(several, F.concat("base_id", F.lit("_"), F.substring("source_id", 1, 8))).otherwise(F.col("base_id"))).drop("base_id")


def artifact_paths(display_id: str, config: Config) -> Column:
    """struct of the paths of a photo's artifacts below the cache folder."""
    return F.struct(*[F.concat(F.lit(f"{config.cache_dir}/{p.split('{}')[0]}"), F.col(display_id), F.lit(p.split("{}")[1])).alias(f"{name}_path") for name, p in ARTIFACTS.items()])


def relative(path: str, folder: str) -> Column:
    """A path without the folder ahead; any other as it is."""
    root = folder.rstrip("/") + "/"
    return F.when(F.col(path).startswith(root), F.substring(F.col(path), F.lit(len(root) + 1), F.length(F.col(path)))).otherwise(F.col(path))


def resolved(path: str, folder: str) -> Column:
    """An absolute path as it is, any other below the folder."""
    return F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), F.col(path)))


def staged_path(source: str, folder: str, config: Config) -> Column:
    """Where a file goes in the staging folder: by its path below the root, else by its name."""
    root = folder.rstrip("/")
    below = F.when(F.col(source).startswith(root + "/"), relative(source, root)).otherwise(F.element_at(F.split(source, "/"), -1))
    return F.concat(F.lit(f"{root}/{config.staging_dir}/"), below)


def inside(path: str, folder: str) -> Column:
    """Whether a path stays below the folder, whatever '..' it has."""
    return (F.col(path).startswith(folder.rstrip("/") + "/")) & ~F.col(path).rlike(r"(^|/)\.\.(/|$)")


def with_event_defaults(events: DataFrame, default_type: str, now: Column) -> DataFrame:
    """schema_version, event_id, event_type and created_at where they are absent or null."""
    defaults = {"schema_version": F.lit("1.0"), "event_id": F.uuid(), "event_type": F.lit(default_type), "created_at": now.cast("long")}
    return events.withColumns({c: F.coalesce(F.col(c), d) if c in events.columns else d for c, d in defaults.items()})


def manifest_record(photos: DataFrame) -> DataFrame:
    """photos with record: struct<status struct<overall, stages>, ui_summary struct<orientation, face_count, foreground_area_ratio, quality_label, warning_flags>>.

    photos: status map<stage, status>, width, height, face_count, area, shadow_clip and highlight_clip. overall is
    success if every stage is done, else partial if one failed, else pending.
    """
    states = F.transform(F.array(*map(F.lit, STAGES)), lambda s: F.coalesce(F.col("status")[s], F.lit("pending")))
    overall = F.when(F.forall(states, lambda s: s.isin("success", "skipped")), "success").when(F.exists(states, lambda s: s == "failed"), "partial").otherwise("pending")
    flags = X.texts((X.finite("shadow_clip", 0.0) > 0.05, "shadow_clip"), (X.finite("highlight_clip", 0.0) > 0.03, "highlight_clip"))
    shown = F.struct(X.orientation("width", "height").alias("orientation"), "face_count", F.col("area").alias("foreground_area_ratio"), F.lit("normal").alias("quality_label"), flags.alias("warning_flags"))
    return photos.withColumn("record", F.struct(F.struct(overall.alias("overall"), F.col("status").alias("stages")).alias("status"), shown.alias("ui_summary")))


def exif_fields(raw: str) -> Column:
    """The 15 useful tags of a raw EXIF document, by their names here."""
    # Tag names.
    tags = {"file_name": "FileName", "file_type": "FileType", "mime_type": "MIMEType", "image_width": "ImageWidth", "image_height": "ImageHeight", "date_time_original": "DateTimeOriginal", "create_date": "CreateDate", "make": "Make", "model": "Model", "lens_model": "LensModel", "focal_length": "FocalLength", "exposure_time": "ExposureTime", "f_number": "FNumber", "iso": "ISO", "orientation": "Orientation"}
    return F.struct(*[F.get_json_object(raw, f"$.{tag}").alias(name) for name, tag in tags.items()])
