"""What has to be computed anew, and how far a run has come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftgrain.config import DEPENDS

DONE = ("success", "skipped")


def source_changed(scan: DataFrame, prior: DataFrame) -> DataFrame:
    """scan (source_id, size, mtime_ns) with `changed`: new, or of another size or time than before."""
    before = prior.select(F.col("source_id").alias("_id"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"))
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("mtime_ns").eqNullSafe(F.col("_mtime"))
    return scan.join(before, F.col("source_id") == F.col("_id"), "left").withColumn("changed", F.col("_id").isNull() | ~same).drop("_id", "_size", "_mtime")


def stale(scan: DataFrame, results: DataFrame, versions: DataFrame, force: bool = False) -> DataFrame:
    """(source_id, stage, reason) of what a run has to compute.

    scan: (source_id, changed). results: (source_id, stage, status, version,
    config_hash, has_output). versions: (stage, version, config_hash), the
    current ones. A stage is stale by itself, or because a stage that it depends
    on (directly or not) is.
    """
    tasks = scan.select("source_id", "changed", F.explode(_versions(versions)).alias("v")).select("source_id", "changed", "v.*")
    prior = results.select("source_id", "stage", F.col("status").alias("_s"), F.col("version").alias("_v"), F.col("config_hash").alias("_c"), F.col("has_output").alias("_o"))
    own = tasks.join(prior, ["source_id", "stage"], "left")
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("changed"), "source_changed")
        .when(F.col("_s").isNull(), "missing")
        .when(~F.col("_s").isin(*DONE), "not_done")
        .when(~F.col("_v").eqNullSafe(F.col("version")), "version")
        .when(~F.col("_c").eqNullSafe(F.col("config_hash")), "config")
        .when(~F.coalesce("_o", F.lit(False)), "output_missing")
    )
    own = own.withColumn("reason", reason)
    upstream = {s: sorted(_upstream(s)) for s in DEPENDS}
    # of each photo the stages that are stale by themselves, then each stage that hangs on one of them
    by_photo = own.groupBy("source_id").agg(F.collect_list(F.struct("stage", "reason")).alias("all"))
    needs = F.create_map(*[x for s, up in upstream.items() for x in (F.lit(s), F.array(*map(F.lit, up)) if up else F.array().cast("array<string>"))])
    broken = F.transform(F.filter("all", lambda x: x["reason"].isNotNull()), lambda x: x["stage"])
    each = by_photo.withColumn("broken", broken).select("source_id", "broken", F.explode("all").alias("x")).select("source_id", "broken", "x.*")
    hangs = F.arrays_overlap(needs[F.col("stage")], F.col("broken"))
    return each.withColumn("reason", F.coalesce("reason", F.when(hangs, "dependency"))).filter("reason IS NOT NULL").select("source_id", "stage", "reason")


def _upstream(stage: str) -> set[str]:
    return set(DEPENDS[stage]) | {u for s in DEPENDS[stage] for u in _upstream(s)}


def _versions(versions: DataFrame) -> Column:
    """The current versions, one a stage (a bounded number), as a literal array."""
    rows = versions.select("stage", "version", "config_hash").collect()
    return F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("stage", "version", "config_hash")]) for r in rows])


def ready(status: str, stage: str) -> Column:
    """Whether all direct dependencies of a stage are done. status: map<stage, status>."""
    return F.forall(F.array(*map(F.lit, DEPENDS[stage])).cast("array<string>"), lambda s: F.coalesce(F.col(status)[s].isin(*DONE), F.lit(False)))


def overall_status(stages: DataFrame, key: str) -> DataFrame:
    """(key, overall): success if all stages are done, else partial if one failed, else pending."""
    done = F.coalesce(F.col("status").isin(*DONE), F.lit(False))
    overall = F.when(F.bool_and(done), "success").when(F.bool_or(F.coalesce(F.col("status") == "failed", F.lit(False))), "partial").otherwise("pending")
    return stages.groupBy(key).agg(overall.alias("overall"))


def status_counts(stages: DataFrame) -> DataFrame:
    return stages.groupBy("stage", "status").agg(F.count("*").alias("n"))


def stage_runtimes(stages: DataFrame) -> DataFrame:
    """(stage, done, total, failed, skipped, duration_ms) of rows (stage, status, duration_ms)."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return stages.groupBy("stage").agg(n("success", "skipped", "failed").alias("done"), F.count("*").alias("total"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.sum("duration_ms").alias("duration_ms"))


def failures(stages: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(source, stage, error) of all failures, and (source, stage, reason) of the first `limit` skipped ones."""
    failed = stages.filter("status = 'failed'").select("source", "stage", F.col("message").alias("error"))
    return failed, stages.filter("status = 'skipped'").select("source", "stage", F.col("message").alias("reason")).orderBy("source", "stage").limit(limit)


def run_totals(stages: DataFrame) -> DataFrame:
    """One row: photos, results by outcome, duration and its estimate for 100 photos."""
    total = F.sum("duration_ms")
    n = F.count_distinct("source")
    return stages.agg(
        n.alias("photos"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        total.alias("duration_ms"),
        F.floor(total / F.greatest(n, F.lit(1)) * 100).cast("long").alias("per_100_ms"),
    )


def task_state(stages: DataFrame, errors: int = 50) -> DataFrame:
    """(task_id, status, current_stage, totals struct<total, success, failed, skipped>, errors): a snapshot of each task.

    stages: (task_id, stage, status, message). The current stage is the last one by name; of the errors the last `errors` by stage stay.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    failed = F.sort_array(F.collect_list(F.when(F.col("status") == "failed", F.struct("stage", "message"))))
    out = stages.groupBy("task_id").agg(F.max("stage").alias("current_stage"), F.struct(F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped")).alias("totals"), failed.alias("errors"))
    state = F.when(F.col("totals.failed") > 0, "partial_success").otherwise("success")
    return out.select("task_id", state.alias("status"), "current_stage", "totals", F.slice("errors", F.greatest(F.lit(1), F.size("errors") - errors + 1), errors).alias("errors"))


def carried_forward(scan: DataFrame, prior: DataFrame, columns: list[str]) -> DataFrame:
    """scan with the given columns of the prior documents where there are any."""
    old = prior.select(F.col("source_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = scan.join(old, F.col("source_id") == F.col("_id"), "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) if c in scan.columns else F.col(f"_{c}") for c in columns})
    return out.drop("_id", *[f"_{c}" for c in columns])


def fingerprint(df: DataFrame, columns: list[str], config: str) -> str:
    """A digest of the settings and of all rows, whatever their order; null and empty differ."""
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    total = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    spark = df.sparkSession
    return spark.range(1).select(F.sha1(F.lit(f"{config}|{total.n}|{total.s}|{total.x}").cast("binary"))).first()[0]


def cached(summary: dict | None, input_hash: str, schema_version: str, force: bool = False) -> dict | None:
    """The earlier summary if it holds for the same input; marked as a cache hit."""
    if force or not summary or summary.get("status") != "success" or summary.get("schema_version") != schema_version or summary.get("input_hash") != input_hash:
        return None
    return summary | {"cache_hit": True}
