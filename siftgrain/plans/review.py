"""Whole runs: from files and features to review sets, and from decisions to a staging plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.operators import contract, decisions, grouping, identity, incremental, ranking, scoring, staging, stats
from siftgrain.operators.store import write_table
from siftgrain.sources import files


@dataclass
class Review:
    """The tables of a review. rejects: (display_id, reject)."""

    photos: DataFrame
    sets: DataFrame
    queue: DataFrame
    slots: DataFrame
    rejects: DataFrame
    input_hash: str

    def documents(self) -> DataFrame:
        """One nested row for each review set, with its photos and its queue in order of rank."""
        first = self.photos.filter("rank = 1").select("set_no", F.col("display_id").alias("primary_keeper_id"))
        member = F.struct("rank", "display_id", "recommendation", "ui_initial_state", "overall", "base_overall", "technical_quality", "face_quality", "iqa", "composition", "score_missing", "badges", "warnings", "reasons", "weaknesses")
        members = self.photos.groupBy("set_no").agg(F.sort_array(F.collect_list(member)).alias("photos"))
        queue = self.queue.groupBy("set_no").agg(F.sort_array(F.collect_list(F.struct("rank", "photo_id", "compare_to", "is_alternate_keeper", "similarity_to_primary", "score_delta", "reason"))).alias("challenger_queue"))
        slots = self.slots.groupBy("set_no").agg(F.sort_array(F.collect_list(F.struct("rank", "slot_id", "photo_id", "similarity_to_keeper", "score_delta", "reason"))).alias("slot_queue"))
        out = self.sets.join(members, "set_no").join(first, "set_no").join(queue, "set_no", "left").join(slots, "set_no", "left")
        n = F.col("photo_count")
        alternates = F.size(F.filter("photos", lambda p: p["recommendation"] == "alternate_keeper"))
        out = out.withColumn("reason_summary", ranking.set_reasons(F.col("set_type"), n, F.lit(1), alternates))
        return out.withColumn("keeper_ids", F.array("primary_keeper_id")).withColumn("challenger_queue", F.coalesce("challenger_queue", F.array()))

    def summary(self) -> DataFrame:
        return stats.review_summary(self.documents())


def preprocess(spark: SparkSession, folder: str, prior: DataFrame, results: DataFrame, versions: DataFrame, config: Config, force: bool = False, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(photos, todo): the photos of a folder with their identity and whether they changed, and the stale (source_id, stage, reason).

    prior: (source_id, size, mtime_ns) of the last run; photos that vanished are in `photos` with gone = true.
    """
    found = identity.identified(files.scan_photos(files.list_files(spark, folder), config, limit))
    photos = incremental.source_changed(found, prior)
    gone = prior.join(photos.select("source_id"), "source_id", "left_anti").select("source_id", "size", "mtime_ns")
    todo = incremental.stale(photos.select("source_id", "changed"), results, versions, force)
    return photos.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True), todo


def with_features(photos: DataFrame, features: DataFrame) -> DataFrame:
    """The photos of a folder that are there and have features, with both; photo_no numbers them by time and name. features: (source_id, the columns of `review`)."""
    here = photos.filter("NOT gone").select("source_id", "display_id")
    met = here.join(features.drop("display_id", "photo_no"), "source_id")
    return stats.row_numbers(met, ["capture_time", "display_id"], "photo_no").withColumn("photo_no", F.col("photo_no").cast("long"))


def review(photos: DataFrame, config: Config) -> Review:
    """Review sets of photos.

    photos: photo_no long, display_id, capture_time, make, model, embedding, fg,
    bg, area, the metrics of `scoring.scored`, face_count, face, has_metrics, and
    optionally the columns of `contract.eligibility`, by which photos are rejected.
    """
    rejects = None
    if "overall_status" in photos.columns:
        judged = contract.eligibility(photos.withColumnRenamed("overall_status", "overall")).drop("overall")
        rejects, photos = judged.filter("reject IS NOT NULL").select("display_id", "reject"), judged.filter("reject IS NULL").drop("reject")
    else:
        rejects = photos.filter("false").select("display_id", F.lit("").alias("reject"))
    input_hash = incremental.fingerprint(photos, sorted(photos.columns), config.snapshot())
    scored = scoring.explained(scoring.scored(photos))
    ordered, _ = write_table(grouping.segments(scored, config), "ordered")
    pairs = grouping.band_pairs(grouping.with_unit_vectors(ordered), config, ["photo_no", "embedding", "fg", "bg", "area"])
    edges = grouping.edge_decision(pairs, config, unit=True).filter("edge").select("a_photo_no", "b_photo_no")
    grouped, _ = write_table(grouping.review_sets(ordered, edges), "review")
    ranked = ranking.ranked(ranking.blended(ranking.group_normalized(grouped)), config)
    signals = grouping.set_type(grouping.set_similarity(ranked), config).drop("n")
    sets = grouping.set_signals(ranked).join(signals, "set_no").join(grouping.set_names(ranked), "set_no")
    return Review(ranked, sets, ranking.challenger_queue(ranked), ranking.slot_queue(ranked, config), rejects, input_hash)


def stage_plan(reviewed: Review, log: DataFrame, inventory: DataFrame, sources: DataFrame, folder: str, config: Config) -> DataFrame:
    """The operations that move all photos whose resolved state isn't keep; decisions on the log overrule roles."""
    seeds = reviewed.photos.filter("ui_initial_state = 'recommended_keep'").select("display_id")
    return staging.plan(sources, decisions.keep_set(seeds, log), inventory, folder, config)


def run(spark: SparkSession, photos: DataFrame, log: DataFrame, inventory: DataFrame, sources: DataFrame, folder: str, config: Config) -> dict[str, DataFrame]:
    """A review and what its decisions come to: photos, sets, queue, violations, plan and its totals."""
    reviewed = review(photos, config)
    plan = stage_plan(reviewed, log, inventory, sources, folder, config)
    return {"photos": reviewed.photos, "sets": reviewed.sets, "queue": reviewed.queue, "documents": reviewed.documents(), "plan": plan, "totals": staging.totals(plan)}


