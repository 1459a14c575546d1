"""The plan that moves what isn't kept, its execution on tables, and its undoing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.operators.identity import staged_path

SIDECARS = ("xmp", "XMP")


def photo_sources(sets: DataFrame) -> DataFrame:
    """(display_id, source) of the photos of all sets; the last set's path wins, photos without a path are left out.

    sets: (seq, photos array<struct<display_id, source_path, source struct<path>>>).
    """
    each = sets.select("seq", F.explode("photos").alias("p")).select("seq", "p.display_id", F.coalesce(F.nullif("p.source_path", F.lit("")), F.nullif(F.col("p.source.path"), F.lit(""))).alias("source"))
    return each.filter("source IS NOT NULL").groupBy("display_id").agg(F.max_by("source", "seq").alias("source"))


def plan(photos: DataFrame, keep: DataFrame, inventory: DataFrame, folder: str, config: Config) -> DataFrame:
    """(display_id, outcome, kind, source, destination, bytes): one row for each operation, fact or issue.

    photos: (display_id, source); keep: (display_id); inventory: (path, size).
    Of a photo's sidecars that differ in case only, the lower-case one counts.
    """
    files = inventory.groupBy("path").agg(F.max("size").alias("size"))
    at = lambda name: files.select(F.col("path").alias(f"_{name}"), F.col("size").alias(f"{name}_size"))
    known = photos.join(keep.select(F.col("display_id").alias("_keep")).distinct(), F.col("display_id") == F.col("_keep"), "left").withColumn("keep", F.col("_keep").isNotNull()).drop("_keep")
    known = known.withColumn("staged", F.when(F.coalesce("source", F.lit("")) != "", staged_path("source", folder, config)))

    def decided(rows: DataFrame, kind: str) -> DataFrame:
        met = rows.join(at("source"), F.col("source") == F.col("_source"), "left").join(at("staged"), F.col("staged") == F.col("_staged"), "left")
        here, there = F.col("_source").isNotNull(), F.col("_staged").isNotNull()
        if kind == "source":
            outcome = (
                F.when(F.coalesce("source", F.lit("")) == "", "missing_source_path")
                .when(F.col("keep") & here, "already_kept")
                .when(F.col("keep") & there, "restore")
                .when(F.col("keep"), "source_missing")
                .when(here, "move")
                .when(there, "already_staged")
                .otherwise("source_missing")
            )
        else:
            outcome = F.when(F.col("keep") & ~here & there, "restore_sidecar").when(~F.col("keep") & here, "move_sidecar")
        back = outcome.startswith("restore")
        size = F.coalesce(F.greatest("source_size", "staged_size"), F.lit(0).cast("long"))
        out = met.withColumn("outcome", outcome).filter("outcome IS NOT NULL")
        return out.select(
            "display_id",
            "outcome",
            F.when(back, f"restore_{kind}").when(outcome.startswith("move"), kind).alias("kind"),
            F.when(back, F.col("staged")).otherwise(F.col("source")).alias("source"),
            F.when(back, F.col("source")).otherwise(F.col("staged")).alias("destination"),
            size.alias("bytes"),
        )

    beside = known.filter("staged IS NOT NULL").select("display_id", "keep", F.regexp_replace("source", r"\.[^./]*$", "").alias("stem"))
    beside = beside.select("display_id", "keep", F.explode(F.array(*[F.concat("stem", F.lit(f".{x}")) for x in SIDECARS])).alias("source"))
    beside = beside.withColumn("staged", staged_path("source", folder, config))
    rest = ["source", "kind", "destination", "bytes"]
    one = decided(beside, "sidecar").groupBy("display_id", "outcome").agg(F.max(F.struct(*rest)).alias("x")).select("display_id", "outcome", "x.*")
    return decided(known, "source").unionByName(one)


def totals(ops: DataFrame) -> DataFrame:
    """(outcome, n, bytes) of a plan."""
    return ops.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def simulate(ops: DataFrame, inventory: DataFrame) -> DataFrame:
    """The log that carrying out a plan's operations would leave: source_missing, destination_exists or success."""
    files = inventory.select("path").distinct()
    moves = ops.filter("kind IS NOT NULL")
    out = moves.join(files.select(F.col("path").alias("_s")), F.col("source") == F.col("_s"), "left").join(files.select(F.col("path").alias("_d")), F.col("destination") == F.col("_d"), "left")
    status = F.when(F.col("_s").isNull(), "source_missing").when(F.col("_d").isNotNull(), "destination_exists").otherwise("success")
    return out.withColumn("status", status).drop("_s", "_d")


def undo(log: DataFrame, batch: str) -> DataFrame:
    """The moves that take a batch's successful operations back, the last one first: (step, display_id, source, destination)."""
    own = log.filter((F.col("operation_batch_id") == batch) & (F.col("status") == "success"))
    return own.select((-F.col("seq")).alias("step"), "display_id", F.col("destination").alias("source"), F.col("source").alias("destination"), "bytes")


def bytes_of(ops: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: the bytes of a plan's operations on the given photos."""
    return ops.join(ids.select("display_id").distinct(), "display_id", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0).cast("long")).alias("bytes"))
