"""The library's queries on the driver's tables, and the SQL that each is held against.

Photos are embeddings with the time and attributes of the event of the same
number; their metrics are values of the embedding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.functions import exprs as X
from siftgrain.operators import contract, decisions, grouping, identity, incremental, ranking, scoring, staging, stats
from siftgrain.operators.store import write_table
from siftgrain.plans.review import Review
from siftgrain.sources import files
from siftgrain.streaming import progress

#: Vectors of the tables are unlike each other; so are the thresholds.
CONFIG = Config(global_threshold=0.25, mixed_threshold=0.27, combined_threshold=0.2, background_veto=0.05, foreground_veto=0.05, near_duplicate=0.3)
GLOBAL = Config(multi=False, global_threshold=0.25, near_duplicate=0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(k: int) -> Column:
    return F.element_at("embedding", k).cast("double")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    out = e.join(v, F.col("event_id") == F.col("vec_id")).select(F.col("vec_id").alias("photo_no"), F.format_string("P%05d", "vec_id").alias("display_id"), "embedding", "label", F.col("ts").cast("timestamp_ntz").alias("capture_time"), "user_id", "event_type", "value")
    none = F.lit(None).cast("string")
    has = F.col("label") % 2 == 0
    part = lambda a: F.when(has, F.slice("embedding", a, 32))
    face = lambda k: F.struct((F.abs(F.element_at("embedding", k + 11)).cast("double") / 5).alias("area_ratio"), (F.abs(F.element_at("embedding", k + 14)).cast("double") * 2000).alias("sharpness"), (F.abs(F.element_at("embedding", k + 17)).cast("double") * 3).alias("alignment"), (1 - F.abs(F.element_at("embedding", k + 20)).cast("double")).alias("confidence"))
    n = (F.col("label") % 3).cast("int")
    faces = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), face)
    out = out.withColumns({
        "make": none, "model": none, "fg": part(1), "bg": part(33), "area": F.col("value") / 500,
        "laplacian_var": F.abs(at(1)) * 4000, "shadow_clip": F.abs(at(2)) / 10, "highlight_clip": F.abs(at(3)) / 10, "brightness_mean": 127.5 + 255 * at(4),
        "contrast_std_ratio": F.abs(at(5)), "dynamic_range": 2 * F.abs(at(6)), "saturation_mean": 1.5 * F.abs(at(7)), "color_cast": F.abs(at(8)),
        "piqe": F.when(F.col("label") != 0, 100 * F.abs(at(9))), "aesthetic": F.when(~F.col("label").isin(0, 1), F.abs(at(10))),
        "center_sharpness_ratio": 2 * F.abs(at(24)), "center_brightness_delta": 255 * at(25), "aspect_ratio": 0.5 + 4 * F.abs(at(26)),
        "faces": faces, "face_count": n, "has_metrics": F.col("label") != 9,
    })
    return out.withColumn("face", scoring.largest_face("faces"))


def _pairs(spark, sf_dir, config=GLOBAL) -> DataFrame:
    return grouping.band_pairs(grouping.segments(grouping.with_unit_vectors(photos(spark, sf_dir)), config), config, ["photo_no", "embedding", "fg", "bg", "area"])


def _sets(spark, sf_dir) -> DataFrame:
    ordered, _ = write_table(grouping.segments(photos(spark, sf_dir), GLOBAL), "ordered")
    pairs = grouping.band_pairs(grouping.with_unit_vectors(ordered), GLOBAL, ["photo_no", "embedding", "fg", "bg", "area"])
    edges = grouping.edge_decision(pairs, GLOBAL, unit=True).filter("edge").select("a_photo_no", "b_photo_no")
    return grouping.review_sets(ordered, edges)


def _ranked(spark, sf_dir) -> DataFrame:
    grouped, _ = write_table(_sets(spark, sf_dir), "sets")
    return ranking.ranked(ranking.blended(ranking.group_normalized(scoring.explained(scoring.scored(grouped)))), GLOBAL)


def _r(*names: str) -> list[Column]:
    return [F.round(n, 4).alias(n) for n in names]


PHOTO = """photo AS (
  SELECT e.vec_id AS photo_no, printf('P%05d', e.vec_id) AS display_id, e.embedding::DOUBLE[] AS e, e.label, v.ts AS capture_time, v.user_id, v.event_type, v.value
  FROM embeddings e JOIN events v ON v.event_id = e.vec_id
)"""
SEGMENT = f"""{PHOTO}, o AS (
  SELECT *, CAST(capture_time AS DATE) AS day, lag(capture_time) OVER (PARTITION BY CAST(capture_time AS DATE) ORDER BY capture_time, display_id) AS prev FROM photo
), s AS (
  SELECT *, sum(CASE WHEN epoch_us(capture_time) - epoch_us(prev) > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY capture_time, display_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM o
), seg AS (SELECT *, row_number() OVER (PARTITION BY day, segment ORDER BY capture_time, display_id) AS rn FROM s)"""
PAIR = f"""{SEGMENT}, pair AS (
  SELECT a.photo_no AS a, b.photo_no AS b, a.display_id AS a_id, b.display_id AS b_id, a.e AS ea, b.e AS eb, a.label AS la, b.label AS lb, a.value / 500 AS va, b.value / 500 AS vb, list_cosine_similarity(a.e, b.e) AS sim
  FROM seg a JOIN seg b ON a.day = b.day AND a.segment = b.segment AND b.rn > a.rn AND b.rn - a.rn <= 40 AND epoch_us(b.capture_time) - epoch_us(a.capture_time) <= 1800000000
)"""
SETS = f"""{PAIR}, link AS (SELECT a, b FROM pair WHERE sim >= 0.25 UNION ALL SELECT b, a FROM pair WHERE sim >= 0.25),
reach AS (SELECT photo_no AS a, photo_no AS b FROM photo UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
sets AS (SELECT a AS photo_no, min(b) AS set_no FROM reach GROUP BY a)"""


def c01(x: str) -> str:
    return f"greatest(0.0, least(1.0, coalesce({x}, 0.0)))"


def mean(*items: tuple[str, str]) -> str:
    return f"({' + '.join(f'{c01(v)} * {w}' for v, w in items)}) / ({' + '.join(w for _, w in items)})"


SCORE = f"""metric AS (
  SELECT *, label % 3 AS face_count, abs(e[1]) * 4000 AS lap, abs(e[2]) / 10 AS shadow, abs(e[3]) / 10 AS highlight, 127.5 + 255 * e[4] AS bright, CASE WHEN label <> 0 THEN 100 * abs(e[9]) END AS piqe,
    CASE WHEN label NOT IN (0, 1) THEN abs(e[10]) END AS aes, CASE WHEN label % 3 = 2 AND abs(e[12]) > abs(e[11]) THEN 1 ELSE 0 END AS f
  FROM photo
), part AS (
  SELECT *,
    {mean(("ln(1 + lap) / ln(801)", "0.35"), ("1 - 8 * shadow - 10 * highlight", "0.2"), ("1 - abs(bright - 127.5) / 127.5", "0.1"), ("abs(e[5]) / 0.22", "0.15"), ("2 * abs(e[6]) / 0.45", "0.1"), ("1 - abs(1.5 * abs(e[7]) - 0.35) / 0.45 - 1.5 * abs(e[8])", "0.1"))} AS technical_quality,
    CASE WHEN face_count = 0 THEN 0.5 ELSE {mean(("ln(1 + abs(e[14 + f]) * 2000) / ln(901)", "0.4"), ("abs(e[11 + f]) / 5 / 0.04", "0.25"), ("abs(e[17 + f]) * 3", "0.2"), ("1 - abs(e[20 + f])", "0.15"))} END AS face_quality,
    CASE WHEN piqe IS NOT NULL AND aes IS NOT NULL THEN {mean(("1 - piqe / 100", "0.7"), ("aes", "0.3"))} WHEN piqe IS NOT NULL THEN {c01("1 - piqe / 100")} ELSE 0.5 END AS iqa,
    {mean(("2 * abs(e[24]) / 1.5", "0.45"), ("1 - 2 * abs(255 * e[25]) / 255", "0.35"), ("1 - greatest(0.0, abs(0.5 + 4 * abs(e[26]) - 1.5) - 1.2) / 2", "0.2"))} AS composition,
    label = 9 AS no_technical, face_count = 0 AS no_face, label = 0 AS no_iqa
  FROM metric
), score AS (SELECT *, {mean(("technical_quality", "0.35"), ("face_quality", "(CASE WHEN face_count > 0 THEN 0.2 ELSE 0.05 END)"), ("iqa", "0.25"), ("composition", "0.2"))} AS base_overall FROM part)"""


def _norm(c: str, missing: str) -> tuple[str, str]:
    own = f"CASE WHEN {missing} THEN NULL ELSE {c} END"
    stat = f"quantile_cont({own}, 0.1) AS lo_{c}, quantile_cont({own}, 0.9) AS hi_{c}, count({own}) AS k_{c}"
    value = f"CASE WHEN k_{c} <= 1 THEN {c} WHEN abs(hi_{c} - lo_{c}) < 1e-9 THEN 0.5 ELSE {c01(f'({c} - lo_{c}) / (hi_{c} - lo_{c})')} END AS n_{c}"
    return stat, value


_N = [_norm("technical_quality", "no_technical"), _norm("face_quality", "no_face"), _norm("iqa", "no_iqa"), _norm("composition", "false")]
NORMAL = f"""{SETS}, {SCORE}, held AS (SELECT set_no, {', '.join(s for s, _ in _N)} FROM score JOIN sets USING (photo_no) GROUP BY set_no),
normal AS (SELECT score.*, set_no, {', '.join(v for _, v in _N)} FROM score JOIN sets USING (photo_no) JOIN held USING (set_no))"""
RANK = f"""{NORMAL}, total AS (SELECT *, {mean(("base_overall", "0.75"), ("n_technical_quality", "0.1"), ("n_face_quality", "0.05"), ("n_iqa", "0.05"), ("n_composition", "0.05"))} AS overall FROM normal),
placed AS (SELECT *, row_number() OVER (PARTITION BY set_no ORDER BY overall DESC, display_id) AS rank, count(*) OVER (PARTITION BY set_no) AS n FROM total),
kept AS (SELECT *, CASE WHEN n >= 9 THEN 3 WHEN n >= 4 THEN 2 ELSE 1 END AS keep_count FROM placed),
ranked AS (SELECT *, CASE WHEN rank = 1 THEN 'keep_candidate' WHEN rank <= keep_count THEN 'alternate_keeper' WHEN rank <= keep_count + 5 THEN 'alternate' ELSE 'lower_ranked' END AS recommendation FROM kept)"""
QUEUE = f"""{RANK}, firsts AS (SELECT set_no, display_id AS compare_to, e AS fe, overall AS fo, face_quality AS ff FROM ranked WHERE rank = 1),
queue AS (SELECT set_no, display_id AS photo_id, rank - 1 AS rank, compare_to, recommendation = 'alternate_keeper' AS is_alternate_keeper, list_cosine_similarity(e, fe) AS sim, overall - fo AS delta, overall,
  CASE WHEN overall >= fo THEN 'close_score' WHEN face_quality > ff THEN 'better_face' ELSE 'same_scene' END AS reason FROM ranked JOIN firsts USING (set_no) WHERE rank > 1)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# files and identity

_FILES = """files AS (SELECT event_id, '/lib/' || ['a', 'b/c', '.siftgrain/x', '__MACOSX', '.to_delete'][(event_id % 5 + 1)::INT] || '/' || event_type || (user_id % 40)::VARCHAR || ['.jpg', '.JPEG', '.heic', '.txt', '', '.3FR', '.crdownload'][(event_id % 7 + 1)::INT] AS path, event_id * 10 AS size FROM events)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*map(F.lit, ["a", "b/c", ".siftgrain/x", "__MACOSX", ".to_delete"])), (F.col("event_id") % 5 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, [".jpg", ".JPEG", ".heic", ".txt", "", ".3FR", ".crdownload"])), (F.col("event_id") % 7 + 1).cast("int"))
    rel = F.concat(folder, F.lit("/"), "event_type", (F.col("user_id") % 40).cast("string"), ext)
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/lib/"), rel).alias("path"), rel.alias("rel_path"), F.element_at(F.split(rel, "/"), -1).alias("file_name"), (F.col("event_id") * 10).alias("size"))


_KEPT = "path NOT LIKE '/lib/.siftgrain/%' AND path NOT LIKE '/lib/\\_\\_MACOSX/%' ESCAPE '\\' AND path NOT LIKE '/lib/.to\\_delete/%' ESCAPE '\\'"
_EXT = "lower(regexp_extract(path, '(\\.[^./]+)$', 1))"


@query("scan_ext_filter", f"WITH {_FILES} SELECT substr(path, 6) AS rel_path, {_EXT} AS extension, size FROM files WHERE {_KEPT} AND {_EXT} IN ('.jpg', '.jpeg', '.heic', '.heif', '.3fr')")
def _(spark, sf_dir):
    return files.scan_photos(_files(spark, sf_dir), GLOBAL).select("rel_path", "extension", "size")


@query("ignored_counts", f"WITH {_FILES}, x AS (SELECT {_EXT} AS ext, regexp_extract(path, '([^/]*)$', 1) AS name FROM files WHERE {_KEPT}) SELECT CASE WHEN ext = '.crdownload' THEN name WHEN ext <> '' THEN ext ELSE name END AS kind, count(*) AS n FROM x WHERE ext NOT IN ('.jpg', '.jpeg', '.heic', '.heif', '.3fr') GROUP BY 1")
def _(spark, sf_dir):
    return files.ignored_counts(_files(spark, sf_dir), GLOBAL)


@query("scan_limit", f"WITH {_FILES} SELECT substr(path, 6) AS rel_path, event_id FROM files WHERE {_KEPT} AND {_EXT} IN ('.jpg', '.jpeg', '.heic', '.heif', '.3fr') ORDER BY rel_path, event_id LIMIT 25")
def _(spark, sf_dir):
    own = files.scan_photos(_files(spark, sf_dir), GLOBAL).orderBy("rel_path", "event_id")
    return own.limit(25).select("rel_path", "event_id")


@query("display_id_collisions", """WITH x AS (
  SELECT p_partkey, p_brand || '/' || p_name AS rel, 'JPG' AS ext, p_name AS stem FROM part
), y AS (SELECT *, substr(sha1(rel), 1, 20) AS source_id, trim(regexp_replace(stem || '_' || ext, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') AS base FROM x)
SELECT p_partkey, source_id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || '_' || substr(source_id, 1, 8) ELSE base END AS display_id FROM y""")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name").alias("rel_path"), F.concat("p_name", F.lit(".jpg")).alias("file_name"), F.lit(".jpg").alias("extension"))
    return identity.identified(own).select("p_partkey", "source_id", "display_id")


@query("staged_paths", f"WITH {_FILES} SELECT event_id, '/lib/.to_delete/' || substr(path, 6) AS staged, substr(path, 6) AS relative FROM files")
def _(spark, sf_dir):
    return _files(spark, sf_dir).select("event_id", identity.staged_path("path", "/lib", GLOBAL).alias("staged"), identity.relative("path", "/lib").alias("relative"))


@query("mime_types", f"WITH {_FILES} SELECT CASE {_EXT} WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.heic' THEN 'image/heic' ELSE 'application/octet-stream' END AS mime, count(*) AS n FROM files GROUP BY 1")
def _(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(X.mime("path").alias("mime")).agg(F.count("*").alias("n"))


# incremental runs

@query("manifest_latest", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, sf_dir):
    return files.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query("incremental_changed", "SELECT event_id AS source_id, event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 7 = 0 AS changed FROM events")
def _(spark, sf_dir):
    now = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), (F.col("event_id") * 3).alias("size"), (F.col("user_id") + 5).alias("mtime_ns"))
    wrong = lambda k: (F.col("source_id") % k == 0).cast("long")
    prior = now.filter("source_id % 7 <> 0").select("source_id", (F.col("size") + wrong(11)).alias("size"), (F.col("mtime_ns") + wrong(13)).alias("mtime_ns"))
    return incremental.source_changed(now, prior).select("source_id", "changed")


_STALE = """WITH v(stage, version, config_hash) AS (VALUES ('metadata', '1', 'a'), ('preview', '2', 'a'), ('face', '1', 'b'), ('person_mask', '1', 'c'), ('image_metrics', '1', 'a'), ('hash', '2', 'a'), ('embedding', '3', 'a')),
own AS (SELECT event_id AS source_id, stage, CASE WHEN event_id % 9 = 0 THEN 'source_changed' WHEN (event_id + length(stage)) % 17 = 0 THEN 'missing' WHEN (event_id + length(stage)) % 5 = 0 THEN 'not_done' WHEN stage = 'preview' AND event_id % 3 = 0 THEN 'version' END AS reason FROM events, v),
need(stage, other) AS (VALUES ('thumb', 'preview'), ('hash', 'preview'), ('face', 'preview'), ('person_mask', 'preview'), ('person_mask', 'face'), ('image_metrics', 'preview'), ('image_metrics', 'person_mask'), ('embedding', 'preview'), ('embedding', 'person_mask'), ('iqa', 'preview')),
up AS (SELECT * FROM need UNION SELECT a.stage, b.other FROM need a JOIN need b ON a.other = b.stage UNION SELECT a.stage, c.other FROM need a JOIN need b ON a.other = b.stage JOIN need c ON b.other = c.stage)
SELECT source_id, stage, coalesce(reason, 'dependency') AS reason FROM own o WHERE reason IS NOT NULL OR EXISTS (SELECT 1 FROM up JOIN own p ON p.stage = up.other WHERE up.stage = o.stage AND p.source_id = o.source_id AND p.reason IS NOT NULL)"""


_VERSIONS = [("metadata", "1", "a"), ("preview", "2", "a"), ("face", "1", "b"), ("person_mask", "1", "c"), ("image_metrics", "1", "a"), ("hash", "2", "a"), ("embedding", "3", "a")]


@query("incremental_stale", _STALE)
def _(spark, sf_dir):
    versions = spark.createDataFrame(_VERSIONS, "stage string, version string, config_hash string")
    scan = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_id"), (F.col("event_id") % 9 == 0).alias("changed"))
    n = F.col("source_id") + F.length("stage")
    results = scan.crossJoin(F.broadcast(versions)).filter(n % 17 != 0)
    results = results.withColumn("status", F.when(n % 5 == 0, "failed").otherwise("success")).withColumn("version", F.when((F.col("stage") == "preview") & (F.col("source_id") % 3 == 0), "1").otherwise(F.col("version"))).withColumn("has_output", F.lit(True))
    return incremental.stale(scan, results, versions)


def _stages(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "success").otherwise("skipped")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("stage"), status.alias("status"), F.col("l_quantity").cast("long").alias("duration_ms"), F.col("l_linestatus").alias("message"))


_STAGE = "st AS (SELECT l_orderkey AS source, 's' || l_linenumber AS stage, CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'success' ELSE 'skipped' END AS status, l_quantity::BIGINT AS duration_ms FROM lineitem)"


@query("count_by_status", f"WITH {_STAGE} SELECT stage, status, count(*) AS n FROM st GROUP BY ALL")
def _(spark, sf_dir):
    return incremental.status_counts(_stages(spark, sf_dir))


@query("overall_status", f"WITH {_STAGE} SELECT source, CASE WHEN bool_and(status IN ('success', 'skipped')) THEN 'success' WHEN bool_or(status = 'failed') THEN 'partial' ELSE 'pending' END AS overall FROM st GROUP BY source")
def _(spark, sf_dir):
    return incremental.overall_status(_stages(spark, sf_dir), "source")


@query("stage_runtimes", f"WITH {_STAGE} SELECT stage, count(*) AS done, count(*) AS total, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(duration_ms)::BIGINT AS duration_ms FROM st GROUP BY stage")
def _(spark, sf_dir):
    return incremental.stage_runtimes(_stages(spark, sf_dir))


@query("run_totals", f"WITH {_STAGE} SELECT count(DISTINCT source) AS photos, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, sum(duration_ms)::BIGINT AS duration_ms, floor(sum(duration_ms) / count(DISTINCT source) * 100)::BIGINT AS per_100_ms FROM st")
def _(spark, sf_dir):
    return incremental.run_totals(_stages(spark, sf_dir))


@query("skipped_list", f"WITH {_STAGE} SELECT source, stage FROM st WHERE status = 'skipped' ORDER BY source, stage LIMIT 100")
def _(spark, sf_dir):
    return incremental.failures(_stages(spark, sf_dir))[1].select("source", "stage")


@query("eligibility_rejects", """SELECT coalesce(CASE WHEN o_orderstatus <> 'F' THEN 'phase1_not_success' WHEN o_custkey % 5 = 0 THEN 'missing_analysis_path' WHEN o_orderkey % 7 = 0 THEN 'analysis_unreadable' WHEN o_custkey % 3 = 0 THEN 'embedding_missing' WHEN o_orderkey % 4 = 0 THEN 'embedding_unreadable' END, 'eligible') AS reject, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "success").otherwise("partial").alias("overall"),
        F.when(F.col("o_custkey") % 5 != 0, "a.json").alias("analysis_path"), (F.col("o_orderkey") % 7 != 0).alias("analysis_ok"),
        F.when(F.col("o_custkey") % 3 != 0, "v.npy").alias("vector_path"), (F.col("o_orderkey") % 4 != 0).alias("vector_ok"),
    )
    return contract.eligibility(o).groupBy(F.coalesce("reject", F.lit("eligible")).alias("reject")).agg(F.count("*").alias("n"))


# sessions, pairs, sets

@query("segments", f"WITH {SEGMENT} SELECT photo_no, day::VARCHAR AS day, segment, rn FROM seg")
def _(spark, sf_dir):
    return grouping.segments(photos(spark, sf_dir), GLOBAL).select("photo_no", F.col("day").cast("string").alias("day"), "segment", F.col("rn").cast("long").alias("rn"))


@query("band_pairs", f"WITH {PAIR} SELECT a, b FROM pair")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.col("a_photo_no").alias("a"), F.col("b_photo_no").alias("b"))


@query("edge_global", f"WITH {PAIR} SELECT a, b, round(sim, 4) AS global_sim FROM pair WHERE sim >= 0.25")
def _(spark, sf_dir):
    return grouping.edge_decision(_pairs(spark, sf_dir), GLOBAL, unit=True).filter("edge").select(F.col("a_photo_no").alias("a"), F.col("b_photo_no").alias("b"), *_r("global_sim"))


_MULTI = f"""{PAIR}, m AS (SELECT *, la % 2 = 0 AS ha, lb % 2 = 0 AS hb, list_cosine_similarity(ea[1:32], eb[1:32]) AS f, list_cosine_similarity(ea[33:64], eb[33:64]) AS g FROM pair),
w AS (SELECT *, CASE WHEN ha AND hb THEN {mean(("sim", "0.45"), ("g", "0.3"), ("f", "0.25"))} END AS combined, CASE WHEN ha AND hb AND g < 0.05 THEN 'background' WHEN ha AND hb AND least(va, vb) >= 0.08 AND f < 0.05 THEN 'foreground' END AS veto FROM m)"""


@query("edge_multi", f"WITH {_MULTI} SELECT a, b, veto, round(combined, 4) AS combined, CASE WHEN ha AND hb THEN veto IS NULL AND combined >= 0.2 WHEN ha OR hb THEN sim >= 0.27 ELSE sim >= 0.25 END AS edge FROM w")
def _(spark, sf_dir):
    return grouping.edge_decision(_pairs(spark, sf_dir, CONFIG), CONFIG, unit=True).select(F.col("a_photo_no").alias("a"), F.col("b_photo_no").alias("b"), "veto", *_r("combined"), "edge")


@query("components", f"WITH RECURSIVE {SETS} SELECT photo_no, set_no FROM sets")
def _(spark, sf_dir):
    return _sets(spark, sf_dir).select("photo_no", "set_no")


@query("component_sizes", f"WITH RECURSIVE {SETS}, n AS (SELECT set_no, count(*) AS size FROM sets GROUP BY set_no) SELECT size, count(*) AS n FROM n GROUP BY size")
def _(spark, sf_dir):
    return stats.distribution(_sets(spark, sf_dir).groupBy("set_no").agg(F.count("*").alias("size")), "size")


_SIGNAL = f"""{SETS}, sp AS (SELECT x.set_no, list_cosine_similarity(p.e, q.e) AS sim FROM sets x JOIN sets y ON x.set_no = y.set_no AND x.photo_no < y.photo_no JOIN photo p ON p.photo_no = x.photo_no JOIN photo q ON q.photo_no = y.photo_no),
sg AS (SELECT set_no, min(sim) AS lo, avg(sim) AS mid, max(sim) AS hi FROM sp GROUP BY set_no), sn AS (SELECT set_no, count(*) AS n FROM sets GROUP BY set_no),
signal AS (SELECT set_no, n, coalesce(lo, 1) AS lo, coalesce(mid, 1) AS mid, coalesce(hi, 1) AS hi FROM sn LEFT JOIN sg USING (set_no))"""


@query("set_signals", f"WITH RECURSIVE {_SIGNAL} SELECT set_no, n, round(lo, 4) AS sim_min, round(mid, 4) AS sim_mean, round(hi, 4) AS sim_max FROM signal")
def _(spark, sf_dir):
    return grouping.set_similarity(_sets(spark, sf_dir)).select("set_no", "n", *_r("sim_min", "sim_mean", "sim_max"))


@query("set_type", f"WITH RECURSIVE {_SIGNAL} SELECT set_no, CASE WHEN n = 1 THEN 'single' WHEN lo >= 0.3 THEN 'near_duplicate' ELSE 'similar_scene' END AS set_type FROM signal")
def _(spark, sf_dir):
    return grouping.set_type(grouping.set_similarity(_sets(spark, sf_dir)), GLOBAL).select("set_no", "set_type")


@query("time_range", f"WITH RECURSIVE {SETS} SELECT set_no, min(capture_time)::VARCHAR AS start, max(capture_time)::VARCHAR AS stop, floor((epoch_us(max(capture_time)) - epoch_us(min(capture_time))) / 1e6)::BIGINT AS duration_seconds FROM sets JOIN photo USING (photo_no) GROUP BY set_no")
def _(spark, sf_dir):
    out = grouping.set_signals(_sets(spark, sf_dir).withColumn("overall", F.lit(0.0)))
    return out.select("set_no", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("stop"), "duration_seconds")


# scores, ranks, queues

@query("photo_score", f"WITH {PHOTO}, {SCORE} SELECT photo_no, round(technical_quality, 4) AS technical_quality, round(face_quality, 4) AS face_quality, round(iqa, 4) AS iqa, round(composition, 4) AS composition, round(base_overall, 4) AS base_overall, concat_ws(',', CASE WHEN no_technical THEN 'technical_quality' END, CASE WHEN no_face THEN 'face_quality' END, CASE WHEN no_iqa THEN 'iqa' END) AS missing FROM score")
def _(spark, sf_dir):
    return scoring.scored(photos(spark, sf_dir)).select("photo_no", *_r("technical_quality", "face_quality", "iqa", "composition", "base_overall"), F.array_join("score_missing", ",").alias("missing"))


@query("largest_face", f"WITH {PHOTO} SELECT photo_no, CASE WHEN label % 3 = 2 AND abs(e[12]) > abs(e[11]) THEN 1 ELSE 0 END AS face, round((CASE WHEN label % 3 = 2 THEN greatest(abs(e[11]), abs(e[12])) ELSE abs(e[11]) END) / 5, 4) AS area_ratio FROM photo WHERE label % 3 > 0")
def _(spark, sf_dir):
    own = photos(spark, sf_dir).filter("face IS NOT NULL")
    return own.select("photo_no", (F.array_position("faces", F.col("face")) - 1).cast("int").alias("face"), F.round("face.area_ratio", 4).alias("area_ratio"))


@query("badges_warnings", f"""WITH {PHOTO}, {SCORE} SELECT photo_no,
  concat_ws(',', CASE WHEN technical_quality >= 0.75 THEN 'technical_good' END, CASE WHEN face_quality >= 0.75 AND face_count > 0 THEN 'face_good' END, CASE WHEN iqa >= 0.7 THEN 'iqa_good' END) AS badges,
  concat_ws(',', CASE WHEN highlight > 0.03 THEN 'highlight_clip' END, CASE WHEN shadow > 0.05 THEN 'shadow_clip' END, CASE WHEN bright < 70 THEN 'underexposed' END, CASE WHEN bright > 190 THEN 'overexposed' END) AS warnings FROM score""")
def _(spark, sf_dir):
    own = scoring.explained(scoring.scored(photos(spark, sf_dir)))
    return own.select("photo_no", F.array_join("badges", ",").alias("badges"), F.array_join("warnings", ",").alias("warnings"))


@query("group_normalized", f"WITH RECURSIVE {NORMAL} SELECT photo_no, set_no, round(n_technical_quality, 4) AS n_technical_quality, round(n_face_quality, 4) AS n_face_quality, round(n_iqa, 4) AS n_iqa, round(n_composition, 4) AS n_composition FROM normal")
def _(spark, sf_dir):
    return _ranked(spark, sf_dir).select("photo_no", "set_no", *_r("n_technical_quality", "n_face_quality", "n_iqa", "n_composition"))


@query("group_percentiles", "SELECT l_orderkey, l_linenumber, round(CASE WHEN count(*) OVER w <= 1 THEN l_discount WHEN abs(quantile_cont(l_discount, 0.9) OVER w - quantile_cont(l_discount, 0.1) OVER w) < 1e-9 THEN 0.5 ELSE greatest(0, least(1, (l_discount - quantile_cont(l_discount, 0.1) OVER w) / (quantile_cont(l_discount, 0.9) OVER w - quantile_cont(l_discount, 0.1) OVER w))) END + 1e-9, 4) AS n_iqa FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("set_no"), "l_linenumber", F.col("l_discount").alias("iqa"), F.array().cast("array<string>").alias("score_missing"))
    return ranking.group_normalized(own, categories=("iqa",)).select(F.col("set_no").alias("l_orderkey"), "l_linenumber", F.round(F.col("n_iqa") + 1e-9, 4).alias("n_iqa"))


@query("rank_roles", f"WITH RECURSIVE {RANK} SELECT photo_no, set_no, round(overall, 4) AS overall, rank, keep_count, recommendation FROM ranked")
def _(spark, sf_dir):
    return _ranked(spark, sf_dir).select("photo_no", "set_no", *_r("overall"), "rank", "keep_count", "recommendation")


@query("challenger_queue", f"WITH RECURSIVE {QUEUE} SELECT set_no, photo_id, rank, compare_to, is_alternate_keeper, round(sim, 4) AS similarity_to_primary, round(delta, 4) AS score_delta, reason FROM queue")
def _(spark, sf_dir):
    return ranking.challenger_queue(_ranked(spark, sf_dir)).select("set_no", "photo_id", "rank", "compare_to", "is_alternate_keeper", *_r("similarity_to_primary", "score_delta"), "reason")


@query("slot_topk", f"WITH RECURSIVE {QUEUE}, t AS (SELECT *, row_number() OVER (PARTITION BY set_no ORDER BY sim DESC, overall DESC, photo_id) AS k FROM queue) SELECT set_no, photo_id, k AS rank, round(sim, 4) AS similarity_to_keeper FROM t WHERE k <= 5")
def _(spark, sf_dir):
    return ranking.slot_queue(_ranked(spark, sf_dir), GLOBAL).select("set_no", "photo_id", "rank", *_r("similarity_to_keeper"))


def _review(spark, sf_dir) -> Review:
    own, _ = write_table(_ranked(spark, sf_dir), "ranked")
    sets = grouping.set_signals(own).join(grouping.set_type(grouping.set_similarity(own), GLOBAL).drop("n"), "set_no").join(grouping.set_names(own), "set_no")
    return Review(own, sets, ranking.challenger_queue(own), ranking.slot_queue(own, GLOBAL), own.filter("false"), "")


@query("set_summary", f"WITH RECURSIVE {RANK}, sp AS (SELECT x.set_no, min(list_cosine_similarity(x.e, y.e)) AS lo FROM ranked x JOIN ranked y ON x.set_no = y.set_no AND x.photo_no < y.photo_no GROUP BY x.set_no), k AS (SELECT set_no, count(*) AS n, count(*) FILTER (recommendation = 'alternate_keeper') AS alt, count(*) FILTER (recommendation = 'lower_ranked') AS low FROM ranked GROUP BY set_no) SELECT count(*) AS sets, count(*) FILTER (n = 1) AS single_sets, count(*) FILTER (n > 1 AND lo >= 0.3) AS near_duplicate_sets, count(*) FILTER (n > 1 AND lo < 0.3) AS similar_scene_sets, sum(n)::BIGINT AS photos, count(*) AS keepers, sum(alt)::BIGINT AS alternate_keepers, (sum(n) - count(*))::BIGINT AS challengers, sum(low)::BIGINT AS lower_ranked FROM k LEFT JOIN sp USING (set_no)")
def _(spark, sf_dir):
    return _review(spark, sf_dir).summary()


@query("contract_violations", "SELECT 'x' AS rule, 'x' AS key WHERE false")
def _(spark, sf_dir):
    r = _review(spark, sf_dir)
    named = r.photos.join(r.sets.select("set_no", "review_set_id"), "set_no")
    first = named.filter("rank = 1").select("set_no", F.col("display_id").alias("primary_id"), "keep_count", F.col("embedding").alias("_e"))
    shown = named.join(first.select("set_no", "_e"), "set_no").withColumn("similarity_to_cover", X.cosine("embedding", "_e"))
    n = r.queue.groupBy("set_no").agg(F.count("*").alias("k"))
    sets = r.sets.join(first.drop("_e"), "set_no").join(n, "set_no", "left").withColumn("challengers", F.coalesce("k", F.lit(0)))
    return contract.review_violations(shown, sets, photos(spark, sf_dir).select("display_id"))


@query("compare_metrics", f"""WITH {PHOTO}, {SCORE}, v AS (SELECT photo_no, unnest(['technical_quality', 'face_quality', 'iqa', 'composition']) AS metric, unnest([round(technical_quality * 1e6), round(face_quality * 1e6), round(iqa * 1e6), round(composition * 1e6)]) AS x, unnest([2.0, 1.5, 1.0, 0.5]) AS w FROM score),
d AS (SELECT a.photo_no, a.metric, a.x - b.x AS delta, abs((a.x - b.x) * a.w) AS impact FROM v a JOIN v b ON b.photo_no = a.photo_no + 1 AND a.metric = b.metric),
t AS (SELECT *, row_number() OVER (PARTITION BY photo_no ORDER BY impact DESC, metric) AS k FROM d) SELECT photo_no, k, metric, delta::BIGINT AS delta_millionths FROM t WHERE k <= 5""")
def _(spark, sf_dir):
    own = scoring.scored(photos(spark, sf_dir)).select("photo_no", F.create_map(*[x for c in scoring.CATEGORIES for x in (F.lit(c), F.round(F.col(c) * 1e6))]).alias("m"))
    right = own.select((F.col("photo_no") - 1).alias("photo_no"), F.col("m").alias("r"))
    weights = {"technical_quality": 2.0, "face_quality": 1.5, "iqa": 1.0, "composition": 0.5}
    rows = own.join(right, "photo_no").select("photo_no", F.posexplode(scoring.metric_differences("m", "r", weights)).alias("k", "d"))
    return rows.select("photo_no", (F.col("k") + 1).cast("long").alias("k"), "d.metric", F.col("d.delta").cast("long").alias("delta_millionths"))


# decisions

_LOG = "log AS (SELECT event_id AS seq, printf('P%05d', user_id) AS display_id, CASE event_type WHEN 'click' THEN 'user_keep' WHEN 'view' THEN 'user_challenger' WHEN 'purchase' THEN 'user_keep' WHEN 'signup' THEN NULL ELSE 'user_undecided' END AS user_state FROM events)"


def _log(spark, sf_dir) -> DataFrame:
    e = F.col("event_type")
    state = F.when(e.isin("click", "purchase"), "user_keep").when(e == "view", "user_challenger").when(e == "signup", F.lit(None)).otherwise("user_undecided")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.format_string("P%05d", "user_id").alias("display_id"), state.alias("user_state"))


@query("latest_decision", f"WITH {_LOG} SELECT display_id, arg_max(user_state, seq) AS user_state FROM log WHERE user_state IS NOT NULL GROUP BY display_id")
def _(spark, sf_dir):
    return decisions.latest_decisions(_log(spark, sf_dir))


_ALL = f"""{_LOG}, seed AS (SELECT printf('P%05d', vec_id) AS display_id, label % 4 = 0 AS keep FROM embeddings), allrows AS (SELECT -1 AS seq, display_id, 'user_keep' AS user_state FROM seed WHERE keep UNION ALL SELECT * FROM log WHERE user_state IS NOT NULL), last AS (SELECT display_id, arg_max(user_state, seq) AS s FROM allrows GROUP BY display_id)"""


def _seeds(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.format_string("P%05d", "vec_id").alias("display_id"), F.when(F.col("label") % 4 == 0, "recommended_keep").otherwise("not_prioritized").alias("ui_initial_state"), (F.col("vec_id") * 100).alias("bytes"))


@query("keep_set", f"WITH {_ALL} SELECT display_id FROM last WHERE s = 'user_keep'")
def _(spark, sf_dir):
    return decisions.keep_set(_seeds(spark, sf_dir).filter("ui_initial_state = 'recommended_keep'"), _log(spark, sf_dir))


@query("pools", f"WITH {_LOG}, l AS (SELECT display_id, arg_max(user_state, seq) AS s FROM log WHERE user_state IS NOT NULL GROUP BY display_id), p AS (SELECT printf('P%05d', vec_id) AS display_id, label, vec_id * 100 AS bytes FROM embeddings) SELECT display_id, coalesce(s, CASE WHEN label % 4 = 0 THEN 'user_keep' ELSE 'user_challenger' END) AS state, CASE WHEN coalesce(s, CASE WHEN label % 4 = 0 THEN 'user_keep' ELSE '' END) = 'user_keep' THEN 'keeper' ELSE 'challenger' END AS pool FROM p LEFT JOIN l USING (display_id)")
def _(spark, sf_dir):
    return decisions.pools(decisions.resolved(_seeds(spark, sf_dir), _log(spark, sf_dir))).select("display_id", "state", "pool")


@query("pool_counts", f"WITH {_LOG}, l AS (SELECT display_id, arg_max(user_state, seq) AS s FROM log WHERE user_state IS NOT NULL GROUP BY display_id), p AS (SELECT vec_id * 100 AS bytes, coalesce(s, CASE WHEN label % 4 = 0 THEN 'user_keep' ELSE '' END) = 'user_keep' AS k FROM embeddings LEFT JOIN l ON display_id = printf('P%05d', vec_id)) SELECT count(*) FILTER (k) AS keepers, count(*) FILTER (NOT k) AS challengers, sum(CASE WHEN k THEN bytes ELSE 0 END)::BIGINT AS keeper_bytes, sum(CASE WHEN k THEN 0 ELSE bytes END)::BIGINT AS challenger_bytes FROM p")
def _(spark, sf_dir):
    return decisions.pool_counts(decisions.resolved(_seeds(spark, sf_dir), _log(spark, sf_dir)))


@query("replace_keeper", "WITH a AS (SELECT event_id AS seq, user_id AS k, user_id + 1 AS c, event_type = 'click' AS r FROM events) SELECT seq * 2 AS seq, printf('P%05d', k) AS display_id, CASE WHEN r THEN 'user_challenger' ELSE 'user_keep' END AS user_state FROM a UNION ALL SELECT seq * 2 + 1, printf('P%05d', c), 'user_keep' FROM a")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("set_000001").alias("review_set_id"), F.format_string("P%05d", "user_id").alias("keeper_id"), F.format_string("P%05d", F.col("user_id") + 1).alias("challenger_id"), F.when(F.col("event_type") == "click", "replace").otherwise("keep_both").alias("action"))
    return decisions.replace_keeper(a).select("seq", "display_id", "user_state")


@query("cyclic_neighbors", "SELECT c_custkey, coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w) AS next_id, coalesce(lag(c_custkey) OVER w, max(c_custkey) OVER (PARTITION BY c_nationkey)) AS previous_id FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("display_id"), "c_nationkey")
    return decisions.neighbours(own, "c_nationkey", "display_id").select(F.col("display_id").alias("c_custkey"), "next_id", "previous_id")


@query("range_select", "WITH x AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem), r AS (SELECT *, max(CASE WHEN l_linenumber = 5 THEN rn END) OVER (PARTITION BY l_orderkey) AS a, max(CASE WHEN l_linenumber = 2 THEN rn END) OVER (PARTITION BY l_orderkey) AS t FROM x) SELECT l_orderkey, l_linenumber FROM r WHERE a IS NOT NULL AND t IS NOT NULL AND rn BETWEEN least(a, t) AND greatest(a, t)")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return decisions.selected_range(own, "l_orderkey", "l_linenumber", F.col("l_linenumber") == 5, F.col("l_linenumber") == 2)


@query("first_order_union", "WITH x AS (SELECT c_nationkey AS id, min(c_custkey) AS ord FROM customer GROUP BY 1), y AS (SELECT s_nationkey + 5 AS id, min(s_suppkey) AS ord FROM supplier GROUP BY 1) SELECT id, 0 AS part, ord FROM x UNION ALL SELECT id, 1, ord FROM y WHERE id NOT IN (SELECT id FROM x)")
def _(spark, sf_dir):
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("ord"))
    y = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 5).alias("id"), F.col("s_suppkey").alias("ord"))
    return decisions.in_first_order(x, y).select("id", F.col("at").getField("col1").alias("part"), "at.ord")


# staging

_INVENTORY = f"""{_ALL}, photo AS (SELECT printf('P%05d', vec_id) AS display_id, vec_id AS n, CASE WHEN vec_id % 29 = 0 THEN '' ELSE '/lib/' || (vec_id % 3) || '/' || printf('P%05d', vec_id) || '.jpg' END AS source FROM embeddings),
inv AS (SELECT source AS path, n * 10 AS size FROM photo WHERE n % 4 < 2 AND source <> '' UNION ALL SELECT '/lib/.to_delete/' || substr(source, 6), n * 10 + 7 FROM photo WHERE n % 4 IN (1, 2) AND source <> '' UNION ALL SELECT replace(source, '.jpg', '.xmp'), 3 FROM photo WHERE n % 5 = 0 AND source <> '' UNION ALL SELECT replace(source, '.jpg', '.XMP'), 5 FROM photo WHERE n % 15 = 0 AND source <> '' UNION ALL SELECT '/lib/.to_delete/' || substr(replace(source, '.jpg', '.XMP'), 6), 4 FROM photo WHERE n % 7 = 0 AND source <> ''),
known AS (SELECT *, coalesce(display_id IN (SELECT display_id FROM last WHERE s = 'user_keep'), false) AS keep, '/lib/.to_delete/' || substr(source, 6) AS staged FROM photo),
main AS (SELECT display_id, keep, source, staged, a.size AS sa, b.size AS sb, a.path IS NOT NULL AS here, b.path IS NOT NULL AS there FROM known LEFT JOIN inv a ON a.path = source LEFT JOIN inv b ON b.path = staged AND source <> ''),
mo AS (SELECT *, CASE WHEN source = '' THEN 'missing_source_path' WHEN keep AND here THEN 'already_kept' WHEN keep AND there THEN 'restore' WHEN keep THEN 'source_missing' WHEN here THEN 'move' WHEN there THEN 'already_staged' ELSE 'source_missing' END AS outcome FROM main),
side AS (SELECT display_id, keep, replace(source, '.jpg', x) AS source, replace(staged, '.jpg', x) AS staged FROM known, (VALUES ('.xmp'), ('.XMP')) t(x) WHERE source <> ''),
so AS (SELECT display_id, side.source, side.staged, a.size AS sa, b.size AS sb, CASE WHEN keep AND a.path IS NULL AND b.path IS NOT NULL THEN 'restore_sidecar' WHEN NOT keep AND a.path IS NOT NULL THEN 'move_sidecar' END AS outcome FROM side LEFT JOIN inv a ON a.path = side.source LEFT JOIN inv b ON b.path = side.staged),
sone AS (SELECT * FROM so WHERE outcome IS NOT NULL QUALIFY row_number() OVER (PARTITION BY display_id, outcome ORDER BY source LIKE '%.XMP') = 1),
plan AS (SELECT display_id, outcome, source, staged, sa, sb FROM mo UNION ALL SELECT display_id, outcome, source, staged, sa, sb FROM sone)"""


def _plan(spark, sf_dir) -> DataFrame:
    n = F.col("vec_id")
    ident = F.format_string("P%05d", n)
    own = table(spark, sf_dir, "embeddings").select(n.alias("n"), ident.alias("display_id"), F.when(n % 29 == 0, "").otherwise(F.concat(F.lit("/lib/"), (n % 3).cast("string"), F.lit("/"), ident, F.lit(".jpg"))).alias("source"))
    real = own.filter("source <> ''")
    staged = lambda x: F.concat(F.lit("/lib/.to_delete/"), F.substring(x, F.lit(6), F.length(x)))
    beside = lambda x: F.regexp_replace("source", r"\.jpg$", x)
    inventory = (
        real.filter("n % 4 < 2").select(F.col("source").alias("path"), (F.col("n") * 10).alias("size"))
        .union(real.filter("n % 4 IN (1, 2)").select(staged(F.col("source")), F.col("n") * 10 + 7))
        .union(real.filter("n % 5 = 0").select(beside(".xmp"), F.lit(3).cast("long")))
        .union(real.filter("n % 15 = 0").select(beside(".XMP"), F.lit(5).cast("long")))
        .union(real.filter("n % 7 = 0").select(staged(beside(".XMP")), F.lit(4).cast("long")))
    )
    keep = decisions.keep_set(_seeds(spark, sf_dir).filter("ui_initial_state = 'recommended_keep'"), _log(spark, sf_dir))
    return staging.plan(own.select("display_id", "source"), keep, inventory, "/lib", GLOBAL)


@query("stage_plan", f"WITH {_INVENTORY} SELECT display_id, outcome, CASE WHEN outcome LIKE 'restore%' THEN staged WHEN outcome = 'missing_source_path' THEN '' ELSE source END AS source, coalesce(greatest(sa, sb), 0)::BIGINT AS bytes FROM plan")
def _(spark, sf_dir):
    return _plan(spark, sf_dir).select("display_id", "outcome", "source", "bytes")


@query("stage_bytes", f"WITH {_INVENTORY} SELECT outcome, count(*) AS n, sum(coalesce(greatest(sa, sb), 0))::BIGINT AS bytes FROM plan GROUP BY outcome")
def _(spark, sf_dir):
    return staging.totals(_plan(spark, sf_dir))


@query("undo_replay", "SELECT -event_id AS step, 'd' || user_id AS source, 's' || user_id AS destination FROM events WHERE event_type <> 'signup' AND event_id % 3 = 1")
def _(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("b"), (F.col("event_id") % 3).cast("string")).alias("operation_batch_id"), F.when(F.col("event_type") == "signup", "failed").otherwise("success").alias("status"), F.lit("").alias("display_id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source"), F.concat(F.lit("d"), F.col("user_id").cast("string")).alias("destination"), F.lit(0).alias("bytes"))
    return staging.undo(log, "b1").select("step", "source", "destination")


# progress

_EVENT = "ev AS (SELECT event_id, user_id % 10 AS task, CASE event_type WHEN 'click' THEN 'stage_progress' WHEN 'view' THEN 'stage_done' WHEN 'purchase' THEN 'progress' ELSE 'note' END AS type, ['metadata', 'preview', 'thumb'][(event_id % 3 + 1)::INT] AS stage, (event_id % 50)::INT AS done, (event_id % 60)::INT AS total FROM events)"
_PROGRESS = f"""{_EVENT}, pr AS (SELECT event_id, task, stage, CASE WHEN total > 0 THEN least(100, floor(done * 100 / total))::INT WHEN type = 'stage_done' THEN 100 ELSE 0 END AS percent FROM ev WHERE type <> 'note')"""


def _events(spark, sf_dir) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "click", "stage_progress").when(e == "view", "stage_done").when(e == "purchase", "progress").otherwise("note")
    stage = F.element_at(F.array(*map(F.lit, ["metadata", "preview", "thumb"])), (F.col("event_id") % 3 + 1).cast("int"))
    raw = F.to_json(F.struct(kind.alias("type"), stage.alias("stage"), (F.col("event_id") % 50).cast("int").alias("done"), (F.col("event_id") % 60).cast("int").alias("total"), (F.col("user_id") % 10).cast("string").alias("taskId")))
    return progress.parsed(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")))


@query("progress_norm", f"WITH {_PROGRESS} SELECT event_id, stage, percent FROM pr")
def _(spark, sf_dir):
    return progress.normalised(_events(spark, sf_dir)).select("event_id", "stage", "percent")


@query("progress_rollup", f"WITH {_PROGRESS}, st AS (SELECT task, stage, max(percent) AS percent, CASE stage WHEN 'metadata' THEN 0 WHEN 'preview' THEN 1 ELSE 2 END AS place FROM pr GROUP BY ALL) SELECT task::VARCHAR AS task_id, round((max(place) * 100 + arg_max(percent, place)) / 3.0, 4) AS overall FROM st GROUP BY task")
def _(spark, sf_dir):
    return progress.rolled_up(progress.stage_state(progress.normalised(_events(spark, sf_dir))), ["metadata", "preview", "thumb"])


@query("progress_throttled", f"WITH {_EVENT} SELECT event_id FROM ev WHERE done <= 1 OR done >= total OR done % greatest(1, least(10, floor(total / 10)))::INT = 0")
def _(spark, sf_dir):
    return progress.throttled(_events(spark, sf_dir)).select("event_id")


@query("recent_events", f"WITH {_EVENT}, r AS (SELECT event_id, task, row_number() OVER (PARTITION BY task ORDER BY event_id DESC) AS k FROM ev) SELECT event_id FROM r WHERE k <= 21")
def _(spark, sf_dir):
    return progress.recent(_events(spark, sf_dir).withColumn("seq", F.col("event_id"))).select("event_id")


# summaries and scalar functions

@query("nearest_rank_pct", "WITH s AS (SELECT l_suppkey, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey, v[(round_even(0.95 * (len(v) - 1), 0))::INT + 1] AS p95, v[(round_even(0.5 * (len(v) - 1), 0))::INT + 1] AS p50 FROM s")
def _(spark, sf_dir):
    return stats.nearest_ranks(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_suppkey"], {"p95": 95, "p50": 50})


@query("metric_summary", "SELECT (l_shipdate::DATE::VARCHAR)[1:7] AS month, count(l_quantity) AS n, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median, min(l_quantity) AS min, max(l_quantity) AS max, round(quantile_cont(l_quantity, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("month"), "l_quantity")
    return stats.summary(own, "l_quantity", ["month"]).select("month", "n", *_r("mean", "median"), "min", "max", *_r("p95"))


@query("distribution", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def _(spark, sf_dir):
    return stats.distribution(table(spark, sf_dir, "embeddings"), "label")


@query("throughput", "SELECT l_shipmode, round(items_per_s, 4) AS items_per_s, round(ms_per_item, 4) AS ms_per_item FROM (SELECT l_linestatus AS l_shipmode, count(*) / sum(l_quantity) * 1000 AS items_per_s, sum(l_quantity) / count(*) AS ms_per_item FROM lineitem GROUP BY 1)")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("l_shipmode"), F.lit(1).alias("items"), F.col("l_quantity").alias("duration_ms"))
    return stats.throughput(own, ["l_shipmode"]).select("l_shipmode", *_r("items_per_s", "ms_per_item"))


@query("last_per_group", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 5")
def _(spark, sf_dir):
    return stats.last_rows(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("batches", "SELECT l_suppkey, floor((rn - 1) / 16)::BIGINT AS batch, count(*) AS n FROM (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) GROUP BY ALL")
def _(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("o"))
    return stats.batched(own, ["l_suppkey"], "o", 16).groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"))


@query("replicated", "SELECT n_nationkey, copy::INT AS copy FROM nation, range(4) t(copy)")
def _(spark, sf_dir):
    return stats.replicated(table(spark, sf_dir, "nation").select("n_nationkey"), 4)


@query("vector_stats", f"WITH {PHOTO} SELECT photo_no, round(sqrt(list_dot_product(e, e)), 4) AS l2_norm, round(list_avg(e), 4) + 0.0 AS mean, round(list_stddev_pop(e), 4) AS std, round(list_min(e), 4) AS min, round(list_max(e), 4) AS max FROM photo")
def _(spark, sf_dir):
    own = photos(spark, sf_dir).select("photo_no", X.vector_stats("embedding").alias("s"))
    return own.select("photo_no", *[(F.round(f"s.{c}", 4) + 0.0).alias(c) for c in ("l2_norm", "mean", "std", "min", "max")])


@query("brightness_hist", f"WITH {PHOTO}, h AS (SELECT photo_no, list_transform(range(16), lambda k: len(list_filter(e, lambda x: least(15, floor((x + 0.5) * 256 * 16 / 256)::INT) = k)) / 64) AS h FROM photo) SELECT photo_no, round(h[9], 4) AS h8, round(h[8], 4) AS h7, round(list_sum(h), 4) AS total FROM h")
def _(spark, sf_dir):
    own = photos(spark, sf_dir).select("photo_no", X.histogram(F.transform("embedding", lambda x: (x.cast("double") + 0.5) * 256), 16).alias("h"))
    return own.select("photo_no", F.round(F.col("h")[8], 4).alias("h8"), F.round(F.col("h")[7], 4).alias("h7"), F.round(F.aggregate("h", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("brightness_curve", f"WITH {PHOTO}, c AS (SELECT photo_no, list_transform(range(64), lambda k: exp(-0.5 * pow(((k + 0.5) * 4 - (100 + value)) / 18, 2))) AS r FROM photo) SELECT photo_no, round(r[33] / list_sum(r), 4) AS mid FROM c")
def _(spark, sf_dir):
    mid = F.lit(100.0) + F.col("value")
    return photos(spark, sf_dir).select("photo_no", F.round(F.element_at(X.brightness_curve(mid - 10, mid, mid + 10), 33), 4).alias("mid"))


@query("hamming_ext", "SELECT o_orderkey, bit_count(xor(o_orderkey * 2654435761, o_custkey * 40503))::INT AS distance FROM orders")
def _(spark, sf_dir):
    h = lambda c, k: F.lpad(F.lower(F.hex(F.col(c) * k)), 16, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", X.hamming(h("o_orderkey", 2654435761), h("o_custkey", 40503)).alias("distance"))


@query("bytes_text", "WITH x AS (SELECT o_orderkey, (o_orderkey * o_orderkey * 17)::DOUBLE AS v FROM orders), y AS (SELECT *, CASE WHEN v < 1 THEN 0 ELSE least(4, floor(ln(v) / ln(1024) + 1e-12)) END::INT AS k FROM x) SELECT o_orderkey, CASE WHEN v / pow(1024, k) < 10 AND k > 0 THEN printf('%.1f', round(v / pow(1024, k), 1)) ELSE printf('%.0f', round(v / pow(1024, k), 0)) END || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] AS text FROM y")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.bytes_text(F.col("o_orderkey") * F.col("o_orderkey") * 17).alias("text"))


@query("capture_text", "SELECT event_id, strftime(ts, '%Y:%m:%d %H:%M:%S') AS text, date_trunc('second', ts)::VARCHAR AS time FROM events")
def _(spark, sf_dir):
    text = X.capture_text(F.col("ts").cast("timestamp_ntz"))
    own = table(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return own.withColumn("time", X.capture_time(F.concat("text", F.lit("+08:00"))).cast("string"))


@query("score_text", "SELECT l_orderkey, l_linenumber, floor(l_discount * 100 + 0.5)::BIGINT::VARCHAR AS score, CASE WHEN l_discount - 0.05 > 0 THEN '+' ELSE '' END || floor((l_discount - 0.05) * 100 + 0.5)::BIGINT AS delta FROM lineitem")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.score_text("l_discount").alias("score"), X.delta_text(F.col("l_discount") - 0.05).alias("delta"))


@query("duplicate_photos", "SELECT l_partkey, count(DISTINCT l_orderkey) AS sets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def _(spark, sf_dir):
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("photos"))
    return nested.select("l_orderkey", F.explode("photos").alias("l_partkey")).groupBy("l_partkey").agg(F.count("*").alias("sets")).filter("sets > 1")
