"""Further queries of the library: readers and writers, projections, contracts, plans and scalar functions.

What is read from files is first written to the shared folder from a table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.config import DEPENDS, STAGES, Config
from siftgrain.functions import exprs as X
from siftgrain.functions import images
from siftgrain.operators import contract, decisions, grouping, identity, incremental, ranking, scoring, staging, stats
from siftgrain.operators.store import drop_table, shared_folder, write_table
from siftgrain.plans import queries as base
from siftgrain.plans.queries import GLOBAL, PHOTO, QUERIES, RANK, SCORE, SETS, SQL, query, table
from siftgrain.sources import files, sinks
from siftgrain.streaming import progress


__all__ = ["QUERIES", "SQL"]


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/siftgrain/{name}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, path: str) -> DataFrame:
    """What df reads from a path as a table of its own, and the path deleted."""
    out, _ = write_table(df, "read")
    drop_table(df.sparkSession, path)
    return out


def _r(*names: str, digits: int = 4):
    return [(F.round(n, digits) + 0.0).alias(n) for n in names]


# readers and writers

_BAD = "event_id % 17 = 0"


def _manifest_lines(spark, sf_dir) -> str:
    """A manifest in the order of event_id; some lines are broken, some blank."""
    path = _place(spark, "manifest")
    own = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("kind"), F.col("event_id").alias("n"))).alias("line"))
    text = F.when(F.expr(_BAD), F.substring("line", 1, 9)).when(F.col("event_id") % 19 == 0, "  ").otherwise(F.col("line"))
    own.repartition(1).sortWithinPartitions("event_id").select(text.alias("value")).write.text(path)
    return path


@query("manifest_lenient", f"SELECT user_id::VARCHAR AS source_id, arg_max(event_type, event_id) AS kind, max(event_id) AS n FROM events WHERE NOT ({_BAD}) AND event_id % 19 <> 0 GROUP BY 1")
def _(spark, sf_dir):
    path = _manifest_lines(spark, sf_dir)
    return _kept(files.read_manifest(spark, path, "source_id string, kind string, n long"), path)


@query("manifest_errors", f"SELECT row_number() OVER (ORDER BY event_id) AS line_no, substr('{{\"source_id\":\"' || user_id || '\"', 1, 9) AS text FROM events WHERE {_BAD}")
def _(spark, sf_dir):
    path = _manifest_lines(spark, sf_dir)
    bad = _kept(files.malformed_lines(spark, path, "source_id string, kind string, n long"), path)
    return stats.row_numbers(bad.select("file", "line", "text"), ["file", "line"], "line_no").select(F.col("line_no").cast("long").alias("line_no"), "text")


@query("jsonl_round_trip", "SELECT event_type, count(*) * 2 AS n, sum(event_id)::BIGINT * 2 AS ids FROM events GROUP BY 1")
def _(spark, sf_dir):
    path = _place(spark, "log")
    own = table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.write_jsonl(own, path)
    sinks.append_jsonl(own, path)
    return _kept(files.read_jsonl(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), path)


@query("documents_or_null", "SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 4 <> 1 THEN n_name END AS name FROM nation")
def _(spark, sf_dir):
    path = _place(spark, "documents")
    text = F.when(F.col("n_nationkey") % 4 == 1, '{"name": ').otherwise(F.to_json(F.struct(F.col("n_name").alias("name"))))
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), text.alias("value")).write.partitionBy("key").text(path)
    read = files.read_document(spark, path, "name string")
    return _kept(read.select(F.regexp_extract("path", r"key=(\d+)", 1).alias("key"), "document.name"), path)


@query("vector_sink", f"WITH {PHOTO}, u AS (SELECT photo_no, e[3] / sqrt(list_dot_product(e, e)) AS x, e[40] / sqrt(list_dot_product(e[33:64], e[33:64])) AS y, label FROM photo) SELECT photo_no, round(x, 4) + 0.0 AS x, CASE WHEN label % 2 = 0 THEN round(y, 4) + 0.0 END AS y FROM u")
def _(spark, sf_dir):
    path, own = _place(spark, "vectors"), base.photos(spark, sf_dir)
    rows = own.select(F.col("photo_no").alias("source_id"), F.lit("global").alias("role"), F.transform("embedding", lambda x: x.cast("float")).alias("vector"))
    sinks.write_vectors(rows.union(own.filter("bg IS NOT NULL").select("photo_no", F.lit("background"), F.transform("bg", lambda x: x.cast("float")))), path)
    vectors = spark.read.parquet(path)
    out = files.optional_vectors(files.optional_vectors(own.select("photo_no", F.col("photo_no").alias("source_id")), vectors, "global", "g"), vectors, "background", "b")
    return _kept(out.select("photo_no", F.col("g")[2].alias("x"), F.col("b")[7].alias("y")).select("photo_no", *_r("x", "y")), path)


@query("decision_log", "SELECT display_id, user_state, n FROM (SELECT 'P' || user_id AS display_id, event_type AS user_state, count(*) AS n FROM events GROUP BY ALL)")
def _(spark, sf_dir):
    path = _place(spark, "decisions")
    none = files.read_log(spark, path)
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("display_id"), F.col("event_type").alias("user_state"))
    sinks.append_jsonl(own, path)
    both = files.read_log(spark, path).unionByName(none)
    return _kept(both.groupBy("display_id", "user_state").agg(F.count("*").alias("n")), path)


@query("review_progress", "SELECT coalesce(CASE WHEN c_custkey % 2 = 0 THEN '1.1' END, '1.0') AS schema_version, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'set_' || c_nationkey END AS completed, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS updated_at FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    own = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, "1.1").alias("schema_version"), F.when(k % 3 != 0, F.array(F.concat(F.lit("set_"), F.col("c_nationkey").cast("string")))).alias("completed_review_set_ids"), F.when(k % 5 != 0, k.cast("long")).alias("updated_at"))
    return files.review_progress(own).select("schema_version", F.array_join("completed_review_set_ids", ",").alias("completed"), "updated_at")


@query("live_file_sizes", "SELECT o_orderkey, greatest(CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 7 END, 0)::BIGINT AS bytes FROM orders")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("/lib/"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("source_path"))
    staged = identity.staged_path("source_path", "/lib", GLOBAL)
    here = own.filter("o_orderkey % 3 <> 0").select(F.col("source_path").alias("path"), F.col("o_custkey").cast("long").alias("size"))
    there = own.filter("o_orderkey % 2 = 0").select(staged.alias("path"), (F.col("o_custkey") + 7).cast("long").alias("size"))
    return files.with_file_sizes(own, here.union(there), staged).select("o_orderkey", "bytes")


@query("summary_document", "SELECT count(*) AS total_photos, 'success' AS status FROM events")
def _(spark, sf_dir):
    path = _place(spark, "summary")
    table(spark, sf_dir, "events").agg(F.count("*").alias("total_photos"), F.lit("success").alias("status")).coalesce(1).write.json(path)
    return _kept(files.read_summary(spark, path).select(F.col("total_photos").cast("long").alias("total_photos"), "status"), path)


@query("folder_list", "SELECT DISTINCT '/photos/' || n_regionkey AS folder FROM nation")
def _(spark, sf_dir):
    lead = F.element_at(F.array(*map(F.lit, ["- ", "1. `", "* ", ""])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ["", "`.", " ", ";"])), (F.col("n_nationkey") % 4 + 1).cast("int"))
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.concat(lead, F.lit("/photos/"), F.col("n_regionkey").cast("string"), tail).alias("text"))
    none = spark.range(3).select((F.col("id") + 100).alias("line"), F.lit("# a heading").alias("text"))
    return files.folder_list(own.union(none)).select("folder")


@query("embedded_previews", "SELECT p_partkey, p_partkey % 3 <> 0 AS found FROM part")
def _(spark, sf_dir):
    raw = F.concat(F.lit(b"headtail"), F.when(F.col("p_partkey") % 3 != 0, F.lit(bytes.fromhex("FFD8FF00"))).otherwise(F.lit(b"none")), F.lit(b"rest"))
    own = table(spark, sf_dir, "part").select("p_partkey", raw.alias("content"), F.lit(8).alias("at"), F.lit(4).alias("size"))
    return own.select("p_partkey", files.byte_slice("content", "at", "size").isNotNull().alias("found"))


@query("cluster_names", f"WITH RECURSIVE {RANK} SELECT set_no, printf('%02d__%s__%s', rank, CASE WHEN recommendation IN ('keep_candidate', 'alternate_keeper') THEN 'KEEP' ELSE 'ALT' END, display_id) AS name FROM ranked")
def _(spark, sf_dir):
    own = base._ranked(spark, sf_dir).select(F.col("set_no").alias("review_set_id"), "rank", "display_id", "recommendation", F.lit("p").alias("preview_path"))
    return sinks.cluster_export(own).select(F.col("review_set_id").alias("set_no"), "name")


@query("config_snapshot", "SELECT 40 AS neighbor_limit, 3600.0 AS segment_gap_s, '.siftgrain' AS cache_dir, true AS sorted_keys")
def _(spark, sf_dir):
    import json

    text = Config().snapshot()
    held = json.loads(text)
    row = (held["neighbor_limit"], held["segment_gap_s"], held["cache_dir"], list(held) == sorted(held))
    return spark.createDataFrame([row], "neighbor_limit int, segment_gap_s double, cache_dir string, sorted_keys boolean")


# identity and projections

_TAGS = ("FileName", "FileType", "MIMEType", "ImageWidth", "ImageHeight", "DateTimeOriginal", "CreateDate", "Make", "Model", "LensModel", "FocalLength", "ExposureTime", "FNumber", "ISO", "Orientation")


@query("exif_fields", "SELECT l_orderkey, l_linenumber, concat_ws('|', " + ", ".join(f"CASE WHEN (l_orderkey + {k}) % 3 <> 0 THEN '{t}' || (l_partkey + {k}) ELSE '-' END" for k, t in enumerate(_TAGS)) + ") AS fields FROM lineitem")
def _(spark, sf_dir):
    raw = F.to_json(F.struct(*[F.when((F.col("l_orderkey") + k) % 3 != 0, F.concat(F.lit(t), (F.col("l_partkey") + k).cast("string"))).alias(t) for k, t in enumerate(_TAGS)], F.lit("x").alias("Software")))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw")).select("l_orderkey", "l_linenumber", identity.exif_fields("raw").alias("f"))
    names = own.schema["f"].dataType.names
    return own.select("l_orderkey", "l_linenumber", F.concat_ws("|", *[F.coalesce(F.col(f"f.{n}"), F.lit("-")) for n in names]).alias("fields"))


@query("artifact_paths", "SELECT p_partkey, '.siftgrain/previews/P' || p_partkey || '.jpg' AS preview, '.siftgrain/masks/P' || p_partkey || '__person.png' AS mask, '.siftgrain/analysis/P' || p_partkey || '/analysis.json' AS analysis FROM part")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("display_id"))
    return own.select("p_partkey", identity.artifact_paths("display_id", GLOBAL).alias("a")).select("p_partkey", F.col("a.preview_path").alias("preview"), F.col("a.person_mask_path").alias("mask"), F.col("a.analysis_path").alias("analysis"))


@query("paths_inside", "SELECT o_orderkey, o_orderkey % 4 = 0 AS inside, CASE WHEN o_orderkey % 4 = 2 THEN '/lib/k' || o_custkey ELSE CASE o_orderkey % 4 WHEN 0 THEN '/lib/a' WHEN 1 THEN '/lib/../a' ELSE '/other/a' END || o_custkey END AS resolved FROM orders")
def _(spark, sf_dir):
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.when(k == 0, "/lib/a").when(k == 1, "/lib/../a").when(k == 2, "k").otherwise("/other/a"), n).alias("path"))
    return own.select("o_orderkey", identity.inside("path", "/lib").alias("inside"), identity.resolved("path", "/lib").alias("resolved"))


@query("carried_forward", "SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 3 <> 0 THEN 'old' || o_custkey END AS note, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey ELSE -1 END AS rating FROM orders")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 5 == 0, "new").alias("note"), "o_custkey")
    prior = own.filter("source_id % 3 <> 0").select("source_id", F.concat(F.lit("old"), F.col("o_custkey").cast("string")).alias("note"), F.col("o_custkey").alias("rating"))
    return incremental.carried_forward(own.drop("o_custkey"), prior, ["note", "rating"]).select("source_id", "note", F.coalesce("rating", F.lit(-1)).alias("rating"))


@query("event_defaults", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'review_decision') AS event_type, '1.0' AS schema_version, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 77 END AS created_at FROM events")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("created_at"))
    return identity.with_event_defaults(own, "review_decision", F.lit(77)).select(F.col("event_id").cast("long").alias("event_id"), "event_type", "schema_version", "created_at")


@query("foreground_enriched", f"WITH {PHOTO} SELECT photo_no, CASE WHEN label % 2 = 0 THEN value / 500 END AS area, CASE WHEN label % 2 = 0 THEN 'person_mask' END AS source FROM photo")
def _(spark, sf_dir):
    own = base.photos(spark, sf_dir)
    area = F.when(F.col("label") % 2 == 0, F.col("area"))
    own = own.select("photo_no", F.struct(F.lit(1.0).alias("other")).alias("image_metrics"), F.struct(area.alias("foreground_area_ratio"), (area * 2).alias("foreground_enhanced_area_ratio")).alias("person_mask"))
    out = scoring.with_foreground(own)
    return out.select("photo_no", F.col("image_metrics.foreground.foreground_area_ratio").alias("area"), F.col("image_metrics.foreground.source").alias("source"))


_COMPARE = {
    "sharpness": "ln(1 + lap) / ln(801)", "center_sharpness": "2 * abs(e[24]) / 1.5", "exposure_clip": "1 - 8 * shadow - 10 * highlight", "brightness": "1 - abs(bright - 127.5) / 127.5", "contrast": "abs(e[5]) / 0.22",
    "dynamic_range": "2 * abs(e[6]) / 0.45", "saturation": "1 - abs(1.5 * abs(e[7]) - 0.35) / 0.45", "color_cast": "1 - 1.5 * abs(e[8])", "piqe": "CASE WHEN piqe IS NOT NULL THEN 1 - piqe / 100 END", "aesthetic": "aes",
}


@query("compare_values", f"WITH {PHOTO}, {SCORE} SELECT photo_no, " + ", ".join(f"CASE WHEN ({x}) IS NOT NULL THEN round({base.c01(x)}, 6) END AS {k}" for k, x in _COMPARE.items()) + " FROM metric")
def _(spark, sf_dir):
    own = scoring.compare_values(base.photos(spark, sf_dir))
    return own.select("photo_no", *[F.col("compare_values")[k].alias(k) for k in _COMPARE])


@query("photo_payload", f"WITH RECURSIVE {RANK}, f AS (SELECT set_no, e AS fe FROM ranked WHERE rank = 1) SELECT display_id, rank, CASE recommendation WHEN 'keep_candidate' THEN 'recommended_keep' WHEN 'alternate_keeper' THEN 'recommended_alternate' WHEN 'alternate' THEN 'user_undecided' ELSE 'not_prioritized' END AS ui_initial_state, round(round(list_cosine_similarity(e, fe), 6), 4) + 0.0 AS similarity_to_cover, label % 2 = 0 AS has_foreground_embedding, label % 2 = 0 AS has_background_embedding, round(round({base.c01('abs(e[5]) / 0.22')}, 6), 4) AS contrast FROM ranked JOIN f USING (set_no)")
def _(spark, sf_dir):
    own = ranking.photo_payload(base._ranked(spark, sf_dir))
    return own.select("display_id", "rank", "ui_initial_state", *_r("similarity_to_cover"), "has_foreground_embedding", "has_background_embedding", F.round(F.col("compare_values")["contrast"], 4).alias("contrast"))


@query("manifest_records", f"WITH {PHOTO}, {SCORE} SELECT photo_no, CASE WHEN label = 9 THEN 'partial' ELSE 'success' END AS overall, face_count::INT AS face_count, concat_ws(',', CASE WHEN shadow > 0.05 THEN 'shadow_clip' END, CASE WHEN highlight > 0.03 THEN 'highlight_clip' END) AS warning_flags, CASE WHEN 0.5 + 4 * abs(e[26]) > 1.1 THEN 'landscape' WHEN 1.0 > 1.1 * (0.5 + 4 * abs(e[26])) THEN 'portrait' ELSE 'squareish' END AS orientation FROM metric")
def _(spark, sf_dir):
    own = base.photos(spark, sf_dir).withColumn("status", F.create_map(*[x for s in STAGES for x in (F.lit(s), F.when(F.col("label") == 9, "failed").otherwise("success"))]))
    out = identity.manifest_record(own.withColumn("width", F.col("aspect_ratio")).withColumn("height", F.lit(1.0)))
    return out.select("photo_no", F.col("record.status.overall").alias("overall"), F.col("record.ui_summary.face_count").cast("int").alias("face_count"), F.array_join("record.ui_summary.warning_flags", ",").alias("warning_flags"), F.col("record.ui_summary.orientation").alias("orientation"))


@query("empty_features", "SELECT 0.35 AS technical, 0.2 AS face, 0.25 AS iqa, 0.2 AS composition, true AS no_value")
def _(spark, sf_dir):
    own = spark.range(1).select(scoring.empty_features().alias("f"))
    return own.select(F.col("f.technical_quality.weight").alias("technical"), F.col("f.face_quality.weight").alias("face"), F.col("f.iqa.weight").alias("iqa"), F.col("f.composition.weight").alias("composition"), F.col("f.iqa.value").isNull().alias("no_value"))


@query("task_state", "WITH s AS (SELECT l_orderkey AS task_id, 's' || l_linenumber AS stage, l_returnflag FROM lineitem) SELECT task_id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS failed, max(stage) AS current_stage, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'partial_success' ELSE 'success' END AS status FROM s GROUP BY task_id")
def _(spark, sf_dir):
    own = base._stages(spark, sf_dir).withColumnRenamed("source", "task_id")
    return incremental.task_state(own).select("task_id", F.col("totals.total").alias("total"), F.col("totals.failed").alias("failed"), "current_stage", "status")


# incremental runs

@query("dependencies_ready", "WITH need(stage, other) AS (VALUES ('thumb', 'preview'), ('hash', 'preview'), ('face', 'preview'), ('person_mask', 'preview'), ('person_mask', 'face'), ('image_metrics', 'preview'), ('image_metrics', 'person_mask'), ('embedding', 'preview'), ('embedding', 'person_mask'), ('iqa', 'preview'), ('metadata', NULL), ('preview', NULL)), s AS (SELECT event_id, other AS stage, ['success', 'skipped', 'failed', NULL][((event_id + length(other)) % 4 + 1)::INT] AS status FROM events, (SELECT DISTINCT stage AS other FROM need)) SELECT e.event_id, need.stage, bool_and(other IS NULL OR coalesce(status IN ('success', 'skipped'), false)) AS ready FROM events e CROSS JOIN need LEFT JOIN s ON s.event_id = e.event_id AND s.stage = need.other GROUP BY ALL")
def _(spark, sf_dir):
    n = lambda s: (F.col("event_id") + len(s)) % 4
    status = F.create_map(*[x for s in DEPENDS for x in (F.lit(s), F.element_at(F.array(F.lit("success"), F.lit("skipped"), F.lit("failed"), F.lit(None)), (n(s) + 1).cast("int")))])
    own = table(spark, sf_dir, "events").select("event_id", status.alias("status"))
    each = F.array(*[F.struct(F.lit(s).alias("stage"), incremental.ready("status", s).alias("ready")) for s in DEPENDS])
    return own.select("event_id", F.explode(each).alias("x")).select("event_id", "x.stage", "x.ready")


@query("input_fingerprint", "SELECT true AS order_free, true AS metric_counts, true AS face_counts, true AS config_counts, true AS hit, false AS hit_of_other")
def _(spark, sf_dir):
    own = base.photos(spark, sf_dir)
    names = sorted(own.columns)
    mark = lambda df, config="c": incremental.fingerprint(df, names, config)
    first = mark(own)
    other = F.when(F.col("photo_no") == F.lit(1), F.col("contrast_std_ratio") + 1).otherwise(F.col("contrast_std_ratio"))
    more = own.withColumn("face_count", F.col("face_count") + (F.col("photo_no") == 1).cast("int"))
    summary = {"status": "success", "schema_version": "1", "input_hash": first}
    row = (mark(own.orderBy(F.desc("photo_no"))) == first, mark(own.withColumn("contrast_std_ratio", other)) != first, mark(more) != first, mark(own, "d") != first, incremental.cached(summary, first, "1") is not None, incremental.cached(summary, "x", "1") is not None)
    return spark.createDataFrame([row], "order_free boolean, metric_counts boolean, face_counts boolean, config_counts boolean, hit boolean, hit_of_other boolean")


# sets

@query("set_scores", f"WITH RECURSIVE {RANK} SELECT set_no, count(*) AS photo_count, round(round(max(overall), 6), 4) AS best_overall, round(round(max(overall) - min(overall), 6), 4) + 0.0 AS score_spread FROM ranked GROUP BY set_no")
def _(spark, sf_dir):
    return grouping.set_signals(base._ranked(spark, sf_dir)).select("set_no", "photo_count", *_r("best_overall", "score_spread"))


@query("set_names", f"WITH RECURSIVE {SETS}, f AS (SELECT set_no, min(struct_pack(t := capture_time, d := display_id)) AS f FROM sets JOIN photo USING (photo_no) GROUP BY set_no) SELECT set_no, printf('set_%06d', row_number() OVER (ORDER BY f)) AS review_set_id FROM f")
def _(spark, sf_dir):
    return grouping.set_names(base._sets(spark, sf_dir))


@query("sets_by_size", f"WITH RECURSIVE {SETS}, n AS (SELECT set_no, count(*) AS photo_count FROM sets GROUP BY set_no) SELECT set_no, photo_count, row_number() OVER (ORDER BY photo_count DESC, set_no) AS place FROM n")
def _(spark, sf_dir):
    return grouping.by_size(base._sets(spark, sf_dir).groupBy("set_no").agg(F.count("*").alias("photo_count"))).select("set_no", "photo_count", F.col("place").cast("long").alias("place"))


@query("review_counters", f"WITH RECURSIVE {SETS} SELECT (SELECT count(*) FROM (SELECT DISTINCT day, segment FROM seg)) AS hard_segments, (SELECT count(*) FROM pair) AS compared_pairs, (SELECT count(*) FROM pair WHERE sim >= 0.25) AS accepted_edges, (SELECT count(DISTINCT set_no) FROM sets) AS review_sets")
def _(spark, sf_dir):
    ordered, _ = write_table(grouping.segments(base.photos(spark, sf_dir), GLOBAL), "ordered")
    pairs = grouping.band_pairs(grouping.with_unit_vectors(ordered), GLOBAL, ["photo_no", "embedding", "fg", "bg", "area"])
    edges = grouping.edge_decision(pairs, GLOBAL, unit=True).filter("edge")
    sets = grouping.review_sets(ordered, edges.select("a_photo_no", "b_photo_no")).select("set_no").distinct()
    return grouping.counters(ordered, pairs, edges, sets)


@query("keeper_slots", f"WITH RECURSIVE {RANK} SELECT set_no, 'slot_1' AS slot_id, display_id AS keeper_photo_id, round(round(overall, 6), 4) AS confidence FROM ranked WHERE rank = 1")
def _(spark, sf_dir):
    return ranking.keeper_slots(base._ranked(spark, sf_dir)).select("set_no", "slot_id", "keeper_photo_id", *_r("confidence"))


@query("challenger_meta", f"WITH RECURSIVE {base.QUEUE} SELECT r.display_id, coalesce(q.rank, 0) AS queue_rank, q.reason FROM ranked r LEFT JOIN queue q ON q.set_no = r.set_no AND q.photo_id = r.display_id")
def _(spark, sf_dir):
    own, _ = write_table(base._ranked(spark, sf_dir), "ranked")
    return ranking.challenger_meta(own, ranking.challenger_queue(own)).select("display_id", F.coalesce("queue_rank", F.lit(0)).alias("queue_rank"), "reason")


@query("keeper_order", f"WITH RECURSIVE {RANK}, k AS (SELECT set_no, display_id, rank FROM ranked WHERE recommendation IN ('keep_candidate', 'alternate_keeper')) SELECT set_no, string_agg(display_id, ',' ORDER BY rank) AS keepers FROM k GROUP BY set_no")
def _(spark, sf_dir):
    own = base._ranked(spark, sf_dir).filter("recommendation IN ('keep_candidate', 'alternate_keeper')")
    return ranking.keepers_in_order(own).select("set_no", F.array_join("keeper_ids", ",").alias("keepers"))


@query("set_reasons", f"WITH RECURSIVE {base._SIGNAL} SELECT set_no, CASE WHEN n = 1 THEN 2 ELSE 3 + (n >= 4)::INT END AS sentences FROM signal")
def _(spark, sf_dir):
    own = grouping.set_type(grouping.set_similarity(base._sets(spark, sf_dir)), GLOBAL)
    alternates = ranking.keep_count(F.col("n"), GLOBAL) - 1
    return own.select("set_no", F.size(ranking.set_reasons(F.col("set_type"), F.col("n"), F.lit(1), alternates)).alias("sentences"))


# contracts, with faults planted

@query("planted_analysis_faults", "SELECT rule, key FROM (SELECT unnest(CASE WHEN s_suppkey % 7 = 0 THEN ['vector_size', 'vector_length'] WHEN s_suppkey % 7 = 1 THEN ['vector_finite', 'vector_length'] WHEN s_suppkey % 7 = 2 THEN ['vector_length'] WHEN s_suppkey % 7 = 3 THEN ['stage_missing:iqa'] WHEN s_suppkey % 7 = 4 THEN ['status_known', 'version'] ELSE [] END) AS rule, s_suppkey::VARCHAR AS key FROM supplier)")
def _(spark, sf_dir):
    k = F.col("source_id") % 7
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    ones = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    photos = own.withColumn("vector", F.when(k == 0, ones(1, 1, 1)).when(k == 1, ones("nan", 1)).when(k == 2, ones(1, 1)).otherwise(ones(0.6, 0.8)))
    stages = own.withColumn("stage", F.explode(F.array(*map(F.lit, STAGES)))).filter(~((k == 3) & (F.col("stage") == "iqa")))
    odd = (k == 4) & (F.col("stage") == "hash")
    stages = stages.select("source_id", "stage", F.when(odd, "odd").otherwise("success").alias("status"), F.when(~odd, "1").alias("version"), F.lit("h").alias("config_hash"))
    return contract.analysis_violations(photos, stages, 2).distinct()


_FAULTS = {
    0: ("rank", 99, ("ranks_complete",)), 1: ("overall", 1.5, ("overall_in_range",)), 2: ("recommendation", "odd", ("role_known", "state_fits_role")), 3: ("ui_initial_state", "odd", ("state_fits_role",)),
    4: ("similarity_to_cover", 3.0, ("similarity_in_range",)),
}


@query("planted_review_faults", """WITH s AS (SELECT s_suppkey AS k FROM supplier), f AS (
  SELECT k, unnest(CASE k % 9 WHEN 0 THEN ['ranks_complete'] WHEN 5 THEN ['photo_count', 'challengers_complete'] WHEN 6 THEN ['single_is_one'] WHEN 7 THEN ['alternates', 'type_known'] WHEN 8 THEN ['primary_is_first'] ELSE [] END) AS rule, 'set' || k AS key FROM s
  UNION ALL SELECT k, unnest(CASE k % 9 WHEN 1 THEN ['overall_in_range'] WHEN 2 THEN ['role_known', 'state_fits_role'] WHEN 3 THEN ['state_fits_role'] WHEN 4 THEN ['similarity_in_range'] ELSE [] END), 'p' || k || '_2' FROM s
  UNION ALL SELECT k, 'photo_missing', 'lost' || k FROM s WHERE k % 4 = 0
  UNION ALL SELECT k, 'photo_unexpected', 'p' || k || '_1' FROM s WHERE k % 10 = 3
) SELECT rule, key FROM f""")
def _(spark, sf_dir):
    """Sets of two photos, each with one fault by its number."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda n: F.concat(F.lit("p"), F.col("k").cast("string"), F.lit(f"_{n}"))
    set_id = F.concat(F.lit("set"), F.col("k").cast("string"))
    columns = ["k", "display_id", "review_set_id", "rank", "recommendation", "ui_initial_state", "overall", "similarity_to_cover"]
    first = s.select("k", name(1).alias("display_id"), set_id.alias("review_set_id"), F.lit(1).alias("rank"), F.lit("keep_candidate").alias("recommendation"), F.lit("recommended_keep").alias("ui_initial_state"), F.lit(0.9).alias("overall"), F.lit(1.0).alias("similarity_to_cover"))
    second = s.select("k", name(2).alias("display_id"), set_id.alias("review_set_id"), F.lit(2).alias("rank"), F.lit("alternate").alias("recommendation"), F.lit("user_undecided").alias("ui_initial_state"), F.lit(0.5).alias("overall"), F.lit(0.8).alias("similarity_to_cover"))
    for n, (column, value, _) in _FAULTS.items():
        second = second.withColumn(column, F.when(F.col("k") % 9 == n, F.lit(value)).otherwise(F.col(column)))
    photos = first.select(*columns).union(second.select(*columns))
    m = F.col("k") % 9
    sets = s.select(set_id.alias("review_set_id"), F.when(m == 6, "single").when(m == 7, "odd").otherwise("similar_scene").alias("set_type"), F.when(m == 5, 3).otherwise(2).alias("photo_count"), F.when(m == 8, name(2)).otherwise(name(1)).alias("primary_id"), F.when(m == 7, 2).otherwise(1).alias("keep_count"), F.when(m == 5, 9).otherwise(1).alias("challengers"))
    expected = photos.select("k", "display_id").filter("NOT (k % 10 = 3 AND display_id LIKE '%\\_1')").select("display_id").union(s.filter("k % 4 = 0").select(F.concat(F.lit("lost"), F.col("k").cast("string"))))
    return contract.review_violations(photos, sets, expected)


# decisions and staging

@query("completed_sets", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b' WHEN c_custkey % 3 = 1 THEN 'a,b,c' ELSE 'x' END AS completed FROM customer")
def _(spark, sf_dir):
    k = F.col("c_custkey") % 3
    before = F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).when(k == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    flipped = F.when(k == 0, "a").when(k == 1, "c").otherwise("x")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(decisions.toggled(before, flipped), ",").alias("completed"))


@query("photo_sources", "WITH x AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS seq, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '/a/' || l_orderkey ELSE '/b/' || l_orderkey END AS source FROM lineitem) SELECT 'P' || l_partkey AS display_id, arg_max(source, seq) AS source FROM x WHERE source IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    n, key = F.col("l_linenumber") % 3, F.col("l_orderkey").cast("string")
    photo = F.struct(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("display_id"), F.when(n == 1, F.concat(F.lit("/a/"), key)).when(n == 0, "").alias("source_path"), F.struct(F.when(n == 2, F.concat(F.lit("/b/"), key)).alias("path")).alias("source"))
    sets = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.array(photo).alias("photos"))
    return staging.photo_sources(sets)


@query("staged_moves", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'source_missing' WHEN o_orderkey % 2 = 0 THEN 'destination_exists' ELSE 'success' END AS status FROM orders")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("source"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("destination"), F.lit("source").alias("kind"))
    inventory = own.filter("o_orderkey % 3 <> 0").select(F.col("source").alias("path")).union(own.filter("o_orderkey % 2 = 0").select("destination"))
    return staging.simulate(own, inventory).select("o_orderkey", "status")


@query("plan_bytes", f"WITH {base._INVENTORY} SELECT coalesce(sum(coalesce(greatest(sa, sb), 0)), 0)::BIGINT AS bytes FROM plan WHERE display_id IN (SELECT printf('P%05d', vec_id) FROM embeddings WHERE vec_id % 3 = 0)")
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").filter("vec_id % 3 = 0").select(F.format_string("P%05d", "vec_id").alias("display_id"))
    return staging.bytes_of(base._plan(spark, sf_dir), ids.union(ids))


@query("preferences", "SELECT event_id AS seq, 'k' || user_id AS keeper_photo_id, 'k' || user_id AS active_keeper_photo_id, 'c' || user_id AS challenger_photo_id, event_type AS decision, event_type AS user_action FROM events")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("s").alias("review_set_id"), F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("keeper_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("challenger_id"), F.col("event_type").alias("action"))
    return decisions.preferences(own).drop("review_set_id")


# progress

@query("task_status", "WITH e AS (SELECT user_id % 50 AS task_id, event_id, CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'completed' WHEN 'purchase' THEN 'failed' ELSE 'note' END AS type FROM events), s AS (SELECT task_id, CASE arg_max(type, event_id) WHEN 'progress' THEN 'running' ELSE arg_max(type, event_id) END AS status FROM e WHERE type <> 'note' GROUP BY 1) SELECT t.task_id, coalesce(status, 'running') AS status, n AS events FROM (SELECT task_id, count(*) AS n FROM e GROUP BY 1) t LEFT JOIN s USING (task_id)")
def _(spark, sf_dir):
    e = F.col("event_type")
    own = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("task_id"), F.col("event_id").alias("seq"), F.when(e == "click", "progress").when(e == "view", "completed").when(e == "purchase", "failed").otherwise("note").alias("type"))
    return progress.task_status(own)


# scalar functions

@query("scalar_numbers", "SELECT l_orderkey, l_linenumber, greatest(2.0, least(20.0, l_quantity)) AS clamped, round(greatest(0.0, least(1.0, l_quantity / 100)), 6) AS aesthetic, CASE WHEN l_quantity > 1.1 * l_linenumber * 5 THEN 'landscape' WHEN l_linenumber * 5 > 1.1 * l_quantity THEN 'portrait' ELSE 'squareish' END AS orientation, round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 4) AS eye_distance, round(1 - least(45.0, abs(degrees(atan2(l_linenumber, l_quantity)))) / 45, 4) AS alignment, round(sqrt(pow(l_quantity - l_linenumber, 2) + 4 * pow(l_discount, 2)) / (l_quantity + l_linenumber), 4) AS anisotropy FROM lineitem")
def _(spark, sf_dir):
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    zero = F.lit(0.0)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.clamp(q, 2.0, 20.0).alias("clamped"), F.round(X.aesthetic(q / 10), 6).alias("aesthetic"), X.orientation(q, n * 5).alias("orientation"), X.eye_geometry(F.array(zero, zero), F.array(q, n)).alias("eye"), X.anisotropy(q, F.col("l_discount").cast("double"), n).alias("tensor"))
    return own.select("l_orderkey", "l_linenumber", "clamped", "aesthetic", "orientation", F.round("eye.eye_distance", 4).alias("eye_distance"), F.round("eye.alignment_score", 4).alias("alignment"), F.round("tensor.gradient_anisotropy", 4).alias("anisotropy"))


@query("scalar_texts", "SELECT p_partkey, regexp_replace(p_name || '/é*', '[^\\p{L}\\p{N}._-]', '_', 'g') AS safe, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '; ' || p_type END AS errors, printf('阴影 %.1f%% · 高光 %.1f%%', (p_partkey % 10) * 0.5, (p_partkey % 7) * 1.0) AS clips, 'data:image/png;base64,' || base64(encode(p_brand)) AS url FROM part")
def _(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_name(F.concat("p_name", F.lit("/é*"))).alias("safe"), X.append_error("p_brand", F.when(k % 2 == 0, "").otherwise(F.col("p_type")), F.lit(None).cast("string")).alias("errors"), X.clip_text((k % 10) * 0.005, (k % 7) * 0.01).alias("clips"), X.data_url(F.lit("a/b.PNG"), F.col("p_brand").cast("binary")).alias("url"))


@query("scalar_maps", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'later' END, 'first') AS a, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + 1 AS kept, (make_timestamp(o_custkey * 1000000) )::VARCHAR AS time FROM orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    later = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("later"))).otherwise(F.create_map().cast("map<string,string>"))
    both = X.merged(F.create_map(F.lit("a"), F.lit("first")), later)
    thin = X.without_nulls(F.create_map(F.lit("x"), F.when(k % 2 == 0, F.lit(1.0)), F.lit("y"), F.lit(2.0)), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", both["a"].alias("a"), F.size(thin).alias("kept"), X.from_mtime(F.col("o_custkey").cast("long") * 1000000000).cast("string").alias("time"))


@query("hash_bits", f"WITH {PHOTO}, b AS (SELECT photo_no, list_transform(range(16), lambda k: (e[4 * k + 1] > 0)::INT * 8 + (e[4 * k + 2] > 0)::INT * 4 + (e[4 * k + 3] > 0)::INT * 2 + (e[4 * k + 4] > 0)::INT) AS d FROM photo) SELECT photo_no, list_aggregate(list_transform(d, lambda x: substr('0123456789abcdef', x + 1, 1)), 'string_agg', '') AS hash FROM b")
def _(spark, sf_dir):
    return base.photos(spark, sf_dir).select("photo_no", X.hash_bits(F.transform("embedding", lambda x: x > 0)).alias("hash"))


@query("shares", f"WITH {PHOTO} SELECT photo_no, len(list_filter(e, lambda x: x > 0.1)) / 64.0 AS high, len(list_filter(e, lambda x: x <= -0.1)) / 64.0 AS low FROM photo")
def _(spark, sf_dir):
    return base.photos(spark, sf_dir).select("photo_no", X.share("embedding", lambda x: x.cast("double") > 0.1).alias("high"), X.share("embedding", lambda x: x.cast("double") <= -0.1).alias("low"))


# pictures: 8 by 8 grey values, made from the vectors

_PICTURE = f"{PHOTO}, pic AS (SELECT photo_no, list_transform(e, lambda x: greatest(0, least(255, floor((x + 0.5) * 256)::INT))) AS p FROM photo)"


def _pictures(spark, sf_dir) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 256).cast("int"))))
    return base.photos(spark, sf_dir).select("photo_no", F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), pixels.alias("pixels")).alias("picture"))


@query("picture_metrics", f"WITH {_PICTURE}, m AS (SELECT photo_no, p, list_avg(p) AS mean FROM pic) SELECT photo_no, round(mean, 4) AS brightness_mean, round(list_aggregate(p, 'quantile_cont', 0.5), 4) AS brightness_p50, round(list_aggregate(p, 'quantile_cont', 0.05), 4) AS p05, round((list_aggregate(p, 'quantile_cont', 0.95) - list_aggregate(p, 'quantile_cont', 0.05)) / 255, 4) AS dynamic_range, round(list_stddev_pop(p) / 255, 4) AS contrast, round(len(list_filter(p, lambda x: x <= 4)) / 64.0, 4) AS shadow, round(len(list_filter(p, lambda x: x >= 251)) / 64.0, 4) AS highlight FROM m")
def _(spark, sf_dir):
    own = _pictures(spark, sf_dir).select("photo_no", images.image_metrics("picture").alias("m"))
    return own.select("photo_no", *[F.round(f"m.{c}", 4).alias(n) for c, n in _METRIC_NAMES.items()])


#: Names of the kernel's fields, and the query's for them.
_METRIC_NAMES = {images.METRIC_FIELDS[k]: n for k, n in ((0, "brightness_mean"), (1, "brightness_p50"), (3, "p05"), (8, "dynamic_range"), (9, "contrast"), (6, "shadow"), (7, "highlight"))}


@query("picture_histograms", f"WITH {_PICTURE} SELECT photo_no, len(list_filter(p, lambda x: x >= 112 AND x < 128)) / 64.0 AS step_7, len(list_filter(p, lambda x: x >= 128 AND x < 144)) / 64.0 AS step_8 FROM pic")
def _(spark, sf_dir):
    own = _pictures(spark, sf_dir).select("photo_no", images.image_histograms("picture").alias("h"))
    return own.select("photo_no", F.col("h.brightness_16")[7].alias("step_7"), F.col("h.brightness_16")[8].alias("step_8"))


@query("picture_hash", f"WITH {_PICTURE}, b AS (SELECT photo_no, list_transform(range(16), lambda k: (p[4 * k + 1] > list_avg(p))::INT * 8 + (p[4 * k + 2] > list_avg(p))::INT * 4 + (p[4 * k + 3] > list_avg(p))::INT * 2 + (p[4 * k + 4] > list_avg(p))::INT) AS d FROM pic) SELECT photo_no, list_aggregate(list_transform(d, lambda x: substr('0123456789abcdef', x + 1, 1)), 'string_agg', '') AS ahash FROM b")
def _(spark, sf_dir):
    own = _pictures(spark, sf_dir).select("photo_no", images.image_hashes("picture").alias("h"))
    return own.select("photo_no", F.col("h.ahash").alias("ahash"))
