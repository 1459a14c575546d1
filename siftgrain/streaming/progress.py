"""Progress of runs as streams: events, state by task, and logs folded to their last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "type string, stage string, done int, total int, percent int, message string, taskId string, error string"
ENDS = ("completed", "failed", "cancelled")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of a growing folder of logs as a stream (raw)."""
    return spark.readStream.format("text").load(folder).withColumnRenamed("value", "raw")


def parsed(lines: DataFrame, task: Column | None = None) -> DataFrame:
    """raw lines as events; a line that is no JSON object is a `log` event with the line as its message."""
    event = F.from_json("raw", EVENT)
    is_json = F.get_json_object("raw", "$.type").isNotNull()
    out = lines.withColumn("e", event).withColumn("is_json", is_json)
    kept = [c for c in lines.columns if c != "raw"]
    return out.select(
        *kept,
        F.when(F.col("is_json"), F.col("e.type")).otherwise("log").alias("type"),
        "e.stage", "e.done", "e.total", "e.percent",
        F.when(F.col("is_json"), F.col("e.message")).otherwise(F.col("raw")).alias("message"),
        (F.coalesce(F.col("e.taskId"), task) if task is not None else F.col("e.taskId")).alias("task_id"),
        "e.error",
    )


def normalised(events: DataFrame) -> DataFrame:
    """The progress events among events, of one form, with percent 0 to 100; other types are left out."""
    total = F.coalesce("total", F.lit(0))
    done = F.when(F.col("type") == "stage_done", F.coalesce("done", F.col("total"), F.lit(0))).otherwise(F.coalesce("done", F.lit(0)))
    percent = F.when(total > 0, F.least(F.lit(100), F.floor(done * 100 / total))).otherwise(F.when(F.col("type") == "stage_done", 100).otherwise(0)).cast("int")
    own = events.filter(F.col("type").isin("stage_progress", "stage_done", "scan_done", "progress"))
    return own.withColumns({"percent": percent, "done": done, "total": total}).withColumn("type", F.lit("progress"))


def throttled(events: DataFrame, every: int | None = None) -> DataFrame:
    """The first, the last and every k-th event of a stage; k is a tenth of the total, 10 at most."""
    k = F.lit(every) if every else F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("total") / 10))).cast("int")
    return events.filter((F.col("done") <= 1) | (F.col("done") >= F.col("total")) | (F.col("done") % k == 0))


def stage_state(progress: DataFrame) -> DataFrame:
    """(task_id, stage, percent): the furthest that each stage has come."""
    return progress.groupBy("task_id", "stage").agg(F.max("percent").alias("percent"))


def rolled_up(state: DataFrame, stages: list[str]) -> DataFrame:
    """(task_id, overall): mean percent over all stages; a stage ahead of one that has begun is complete."""
    place = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    own = state.withColumn("place", place[F.col("stage")]).filter("place IS NOT NULL")
    at = own.groupBy("task_id").agg(F.max_by("percent", "place").alias("percent"), F.max("place").alias("place"))
    return at.select("task_id", F.round((F.col("place") * 100 + F.col("percent")) / len(stages), 4).alias("overall"))


def task_status(events: DataFrame, seq: str = "seq") -> DataFrame:
    """(task_id, status, events): what the last event that says so makes of a task; running before any.

    An end is its own status, progress after it makes the task run again, and
    other events leave it as it is. On a stream a running state.
    """
    says = F.when(F.col("type").isin(*ENDS), F.col("type")).when(F.col("type") == "progress", "running")
    at = F.when(says.isNotNull(), F.col(seq))  # max_by passes over rows with a null place
    return events.groupBy("task_id").agg(F.coalesce(F.max_by(says, at), F.lit("running")).alias("status"), F.count("*").alias("events"))


def recent(events: DataFrame, k: int = 21) -> DataFrame:
    """The last k events of each task. events: (task_id, seq, ...), not a stream."""
    w = Window.partitionBy("task_id").orderBy(F.col("seq").desc())
    return events.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def latest_by_key(log: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """The last value of each key; on a stream a running state, to be written in complete or update mode."""
    return log.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, seq).alias(value))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Work through what is there, into a table in memory."""
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def cancel(spark: SparkSession, tag: str) -> list[str]:
    """Interrupt the jobs that were started under a tag."""
    return spark.interruptTag(tag)
