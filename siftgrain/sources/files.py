"""Readers: folders of photos, JSON documents and logs, vectors, folder lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftgrain.config import EXTENSIONS, SILENT_EXTENSIONS, SILENT_NAMES, Config
from siftgrain.functions import exprs as X

DECISIONS = "seq long, schema_version string, event_id string, event_type string, review_set_id string, display_id string, previous_user_state string, user_state string, source string, created_at long"
PREFERENCES = "seq long, event_id string, event_type string, review_set_id string, keeper_photo_id string, active_keeper_photo_id string, challenger_photo_id string, decision string, user_action string, created_at long"
PROGRESS = "review_set_ids array<string>, completed_review_set_ids array<string>, updated_at long"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rel_path, file_name, size, mtime_ns) of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^[a-z]+:/*", "/")
    rel = F.substring(F.regexp_replace("path", r"^[a-z]+:/*", "/"), F.length(root) + 2, F.lit(1 << 20))
    return files.select("path", rel.alias("rel_path"), F.element_at(F.split(rel, "/"), -1).alias("file_name"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def in_pruned_folder(rel_path: str, config: Config) -> Column:
    """Whether a folder on the path is one that a scan doesn't enter."""
    pruned = {config.cache_dir, *config.ignored_dirs, *([config.staging_dir] if config.prune_staging else [])}
    folders = F.slice(F.split(rel_path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(rel_path, "/")) - 1))
    return F.exists(folders, lambda f: f.isin(*pruned) | f.startswith(config.hidden_prefix))


def scan_photos(files: DataFrame, config: Config, limit: int | None = None) -> DataFrame:
    """Photos among the files, by path; with a limit the first ones."""
    out = files.filter(~in_pruned_folder("rel_path", config)).withColumn("extension", X.extension("file_name")).filter(F.col("extension").isin(*EXTENSIONS))
    return out.orderBy("rel_path").limit(limit) if limit is not None else out


def ignored_counts(files: DataFrame, config: Config) -> DataFrame:
    """(kind, n) of the files that are no photos: by extension, else by name, else <none>."""
    ext = X.extension("file_name")
    silent = F.col("file_name").isin(*SILENT_NAMES) | ext.isin(*SILENT_EXTENSIONS)
    kind = F.coalesce(F.nullif(ext, F.lit("")), F.nullif(F.col("file_name"), F.lit("")), F.lit("<none>"))
    return files.filter(~in_pruned_folder("rel_path", config) & ~ext.isin(*EXTENSIONS)).groupBy(F.when(silent, F.col("file_name")).otherwise(kind).alias("kind")).agg(F.count("*").alias("n"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One JSON document a line. strict: a malformed line is an error; else it is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of the lines that aren't blank; line grows in file order."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    return text.filter(F.trim("text") != "")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Manifest lines by source_id: bad lines left out, the last of several wins."""
    parsed = read_lines(spark, path).select("file", "line", F.from_json("text", schema, {"mode": "PERMISSIVE"}).alias("d")).filter("d.source_id IS NOT NULL")
    return latest(parsed.select("file", "line", "d.*"), ["source_id"], ["file", "line"]).drop("file", "line")


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, text) of the lines that aren't blank and don't read as a document of the schema with a source_id: what a strict reader's error names."""
    parsed = read_lines(spark, path).withColumn("d", F.from_json("text", schema, {"mode": "PERMISSIVE"}))
    return parsed.filter("d.source_id IS NULL").select("file", "line", "text")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}") for c in rest]).select(*df.columns)


def read_document(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """(path, document) of whole JSON files; a document that can't be read is null."""
    whole = spark.read.option("wholetext", "true").text(paths)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("document"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_log(spark: SparkSession, path: str, schema: str = DECISIONS) -> DataFrame:
    """An append-only log; without a file an empty one."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """A summary document; an error if absent."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)


def review_progress(df: DataFrame) -> DataFrame:
    """A progress document with the defaults filled in."""
    return df.select(
        F.coalesce("schema_version", F.lit("1.0")).alias("schema_version"),
        F.coalesce("completed_review_set_ids", F.array().cast("array<string>")).alias("completed_review_set_ids"),
        F.coalesce("updated_at", F.lit(0).cast("long")).alias("updated_at"),
    )


def with_file_sizes(photos: DataFrame, inventory: DataFrame, staged: Column) -> DataFrame:
    """photos (with source_path) and the larger of their sizes at the source and in the staging folder."""
    at = inventory.select(F.col("path").alias("at_path"), F.col("size").alias("at_size"))
    out = photos.withColumn("staged_path", staged).join(at, F.col("source_path") == F.col("at_path"), "left").drop("at_path").withColumnRenamed("at_size", "source_size")
    out = out.join(at, F.col("staged_path") == F.col("at_path"), "left").drop("at_path").withColumnRenamed("at_size", "staged_size")
    return out.withColumn("bytes", F.coalesce(F.greatest("source_size", "staged_size"), F.lit(0).cast("long")))


def optional_vectors(photos: DataFrame, vectors: DataFrame, role: str, out: str) -> DataFrame:
    """photos with the unit vector of a role; null where there is none."""
    own = vectors.filter(F.col("role") == role).select(F.col("source_id").alias("_v"), X.l2_normalize("vector").alias(out))
    return photos.join(own, F.col("source_id") == F.col("_v"), "left").drop("_v")


def folder_list(lines: DataFrame) -> DataFrame:
    """Absolute folders named in the lines of a Markdown text, each once, in order. lines: (line, text)."""
    bare = F.regexp_replace(F.regexp_replace("text", r"^\s*(?:[-*+]|\d+[.)])\s+", ""), "[`\"']", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(/[^\s].*)$", 1), r"[\s.,;:)]+$", "")
    found = lines.select("line", path.alias("folder")).filter("folder != ''")
    return found.groupBy("folder").agg(F.min("line").alias("line")).orderBy("line")


def byte_slice(content: str, offset: str, size: str) -> Column:
    """The JPEG at a place of a binary; null unless it begins like one."""
    part = F.substring(F.col(content), F.col(offset).cast("int") + 1, F.col(size).cast("int"))
    return F.when(F.substring(part, 1, 2) == F.lit(bytes.fromhex("FFD8")), part)
