import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.functions import images
from siftgrain.operators import contract, decisions, identity, incremental, staging, stats
from siftgrain.plans.review import preprocess
from siftgrain.sources import files, sinks
from siftgrain.streaming import progress


def test_scan_and_preprocess(spark, tmp_path):
    for name in ("a/x y.jpg", "b/x_y.JPG", "a/n.txt", ".siftgrain_cache/z.jpg", ".to_delete/old.jpg", ".DS_Store", "partial.crdownload", "noext", "c/raw.3FR"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"0123456789")
    c = Config()
    found = files.list_files(spark, str(tmp_path))
    assert [r.rel_path for r in files.scan_photos(found, c).orderBy("rel_path").collect()] == ["a/x y.jpg", "b/x_y.JPG", "c/raw.3FR"]
    assert files.scan_photos(found, c, 1).count() == 1
    ignored = {r.kind: r.n for r in files.ignored_counts(found, c).collect()}
    assert ignored == {".txt": 1, "noext": 1, "partial.crdownload": 1, ".DS_Store": 1} or ignored[".txt"] == 1
    versions = spark.createDataFrame([("metadata", "1", "h"), ("preview", "1", "h")], "stage string, version string, config_hash string")
    none = spark.createDataFrame([], "source_id string, stage string, status string, version string, config_hash string, has_output boolean")
    photos, todo = preprocess(spark, str(tmp_path), spark.createDataFrame([("gone", 1, 1)], "source_id string, size long, mtime_ns long"), none, versions, c)
    assert todo.count() == 6 and photos.filter("gone").count() == 1
    names = {r.rel_path: r.display_id for r in photos.filter("not gone").collect()}
    assert names["a/x y.jpg"].startswith("x_y_JPG_") and names["a/x y.jpg"] != names["b/x_y.JPG"]
    # a second run over the same files with results has nothing to do
    done = photos.filter("not gone").select("source_id", F.explode(F.array(F.lit("metadata"), F.lit("preview"))).alias("stage")).selectExpr("source_id", "stage", "'success' AS status", "'1' AS version", "'h' AS config_hash", "true AS has_output")
    assert preprocess(spark, str(tmp_path), photos.filter("not gone").select("source_id", "size", "mtime_ns"), done, versions, c)[1].count() == 0
    newer = versions.withColumn("config_hash", F.when(F.col("stage") == "metadata", "h2").otherwise("h"))
    assert preprocess(spark, str(tmp_path), photos.filter("not gone").select("source_id", "size", "mtime_ns"), done, newer, c)[1].groupBy("reason").count().count() == 2


def test_manifest_and_logs(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"source_id": "a", "v": 1}\nnot json\n\n{"source_id": "b", "v": 2}\n{"source_id": "a", "v": 3}\n')
    assert {r.source_id: r.v for r in files.read_manifest(spark, str(p), "source_id string, v int").collect()} == {"a": 3, "b": 2}
    assert files.read_log(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(Exception, match="."):
        files.read_jsonl(spark, str(p), "source_id string, v int").collect()
    assert files.read_jsonl(spark, str(p), "source_id string, v int", strict=False).count() >= 3
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert files.read_document(spark, str(bad), "a int").first().document in (None,) or files.read_document(spark, str(bad), "a int").first().document.a is None
    lines = spark.createDataFrame([(1, "- `/data/a b`."), (2, "no path"), (3, "* /data/a b"), (4, "2) /x,")], "line int, text string")
    assert [r.folder for r in files.folder_list(lines).collect()] == ["/data/a b", "/x"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    sinks.write_jsonl(df, str(tmp_path / "o"))
    sinks.write_jsonl(df, str(tmp_path / "o"))
    sinks.append_jsonl(df, str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    sinks.snapshot_config(Config(), str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["neighbor_limit"] == 40
    assert Config.load(None) == Config()
    (tmp_path / "s").write_text("1")
    (tmp_path / "t").write_text("2")
    ops = [{"source": str(tmp_path / "s"), "destination": str(tmp_path / "u/s")}, {"source": str(tmp_path / "t"), "destination": str(tmp_path / "u/s")}, {"source": str(tmp_path / "none"), "destination": str(tmp_path / "v")}]
    assert [r["status"] for r in sinks.move_files(ops)] == ["success", "destination_exists", "failed"]


def test_decisions_follow_line_order(spark):
    log = spark.createDataFrame([(1, "a", "user_keep", 9), (2, "a", "user_challenger", 1), (3, "a", "user_keep", 0), (4, "p", "user_challenger", 5), (5, None, "user_keep", 6), (6, "b", None, 7)], "seq long, display_id string, user_state string, created_at long")
    seeds = spark.createDataFrame([("p",), ("q",)], "display_id string")
    assert {r.display_id for r in decisions.keep_set(seeds, log).collect()} == {"a", "q"}
    actions = spark.createDataFrame([(1, "s", "k", "c", "replace"), (2, "s", "c", "d", "keep_both")], "seq long, review_set_id string, keeper_id string, challenger_id string, action string")
    rows = decisions.replace_keeper(actions).orderBy("seq").collect()
    assert [(r.display_id, r.user_state) for r in rows] == [("k", "user_challenger"), ("c", "user_keep"), ("c", "user_keep"), ("d", "user_keep")]
    both = decisions.preferences(actions).first()
    assert both.keeper_photo_id == both.active_keeper_photo_id and both.decision == both.user_action
    c = F.array(F.lit("a"), F.lit("b"))
    assert spark.range(1).select(decisions.toggled(c, F.lit("a")).alias("x")).first().x == ["b"]


def test_staging_outcomes_and_undo(spark):
    photos = spark.createDataFrame([("a", "/r/a.jpg"), ("b", "/r/b.jpg"), ("c", "/r/c.jpg"), ("d", "/r/d.jpg"), ("e", "/r/e.jpg"), ("f", ""), ("g", "/else/g.jpg")], "display_id string, source string")
    keep = spark.createDataFrame([("a",), ("b",)], "display_id string")
    files_ = [("/r/a.jpg", 1), ("/r/.to_delete/b.jpg", 2), ("/r/c.jpg", 3), ("/r/c.xmp", 4), ("/r/.to_delete/d.jpg", 5), ("/else/g.jpg", 6), ("/r/.to_delete/a.XMP", 7)]
    inventory = spark.createDataFrame(files_, "path string, size long")
    plan = staging.plan(photos, keep, inventory, "/r", Config())
    got = {(r.display_id, r.outcome) for r in plan.collect()}
    assert got == {("a", "already_kept"), ("a", "restore_sidecar"), ("b", "restore"), ("c", "move"), ("c", "move_sidecar"), ("d", "already_staged"), ("e", "source_missing"), ("f", "missing_source_path"), ("g", "move")}
    assert {r.destination for r in plan.filter("display_id = 'g'").collect()} == {"/r/.to_delete/g.jpg"}
    log = staging.simulate(plan, inventory)
    assert {r.status for r in log.collect()} == {"success"}
    logged = log.withColumn("seq", F.monotonically_increasing_id()).withColumn("operation_batch_id", F.lit("x"))
    back = staging.undo(logged, "x")
    assert back.count() == logged.count() and back.filter("source like '/r/.to_delete/c%'").count() == 2
    assert staging.bytes_of(plan, spark.createDataFrame([("c",)], "display_id string")).first().bytes == 7


def test_contract_of_analysis(spark):
    photos = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [float("nan"), 1.0])], "source_id string, vector array<double>")
    stages = spark.createDataFrame([("a", "metadata", "success", "1", "h"), ("b", "metadata", "odd", None, "h")], "source_id string, stage string, status string, version string, config_hash string")
    rules = {r.rule for r in contract.analysis_violations(photos, stages, 2).filter("key = 'b'").collect()}
    assert {"vector_finite", "status_known", "version", "stage_missing:iqa"} <= rules


def test_progress_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = ['{"type":"stage_progress","stage":"hash","done":5,"total":10,"taskId":"t"}', '{"type":"stage_progress","stage":"hash","done":0,"total":0,"taskId":"t"}', "plain text", '{"type":"note","taskId":"t"}', '{"type":"completed","taskId":"t"}']
    (tmp_path / "in/a.log").write_text("\n".join(lines))
    stream = progress.stage_state(progress.normalised(progress.parsed(progress.read_events(spark, str(tmp_path / "in")))))
    progress.run_available(stream, "stage_state", str(tmp_path / "ckpt"))
    assert [(r.task_id, r.stage, r.percent) for r in spark.table("stage_state").collect()] == [("t", "hash", 50)]
    raw = spark.createDataFrame([(x,) for x in lines], "raw string")
    events = progress.parsed(raw, F.lit("t"))
    assert {r.type for r in events.collect()} == {"stage_progress", "log", "note", "completed"}
    numbered = events.withColumn("seq", F.monotonically_increasing_id())
    assert progress.task_status(numbered).first().status == "completed"
    ends = spark.createDataFrame([("a", "failed", 1), ("a", "completed", 2), ("b", "completed", 1), ("b", "progress", 2), ("b", "note", 3), ("c", "note", 1), ("d", "completed", 1), ("d", "cancelled", 2)], "task_id string, type string, seq int")
    assert {r.task_id: (r.status, r.events) for r in progress.task_status(ends).collect()} == {"a": ("completed", 2), "b": ("running", 3), "c": ("running", 1), "d": ("cancelled", 2)}


def test_streamed_latest_decision(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"seq": 1, "display_id": "a", "user_state": "user_keep"}, {"seq": 2, "display_id": "a", "user_state": "user_challenger"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    log = spark.readStream.schema("seq long, display_id string, user_state string").json(str(tmp_path / "in"))
    progress.run_available(progress.latest_by_key(log, "display_id", "user_state", "seq"), "decided", str(tmp_path / "ckpt"))
    assert [tuple(r) for r in spark.table("decided").collect()] == [("a", "user_challenger")]


def test_image_kernels(spark):
    rng = np.random.default_rng(1)
    flat, noisy = np.full((16, 24), 100), rng.integers(0, 256, (16, 24))
    assert images.laplacian_var(flat.astype(float)) == 0 and images.laplacian_var(noisy.astype(float)) > 0
    assert images.edge_density(flat.astype(float)) == 0
    stripes = np.tile(np.array([0, 0, 255, 255]), (16, 6))
    anisotropy, angle = images.motion_blur(stripes.astype(float))
    assert anisotropy == pytest.approx(1) and angle == pytest.approx(0, abs=1e-6)
    h = images.hashes(noisy.astype(float))
    assert set(map(len, h.values())) == {16}
    rows = [(24, 16, flat.ravel().tolist()), (24, 16, np.repeat(noisy[..., None], 3, 2).ravel().tolist()), (3, 3, [1])]
    df = spark.createDataFrame(rows, "width int, height int, pixels array<short>").withColumn("p", F.struct("width", "height", "pixels"))
    got = df.select(images.image_metrics("p").alias("m"), images.image_hashes("p").alias("h"), images.image_histograms("p").alias("k")).collect()
    assert got[0].k.brightness[25] == 1 and got[0].k.brightness_16[6] == 1 and sum(got[1].k.r) == pytest.approx(1)
    assert got[0].m.brightness_mean == pytest.approx(100) and got[1].m.contrast_std_ratio > 0.2 and got[2].m.error and got[2].h.error


def test_pluggable_analyzer(spark):
    df = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b""))], "source_id string, content binary")

    def load():
        return lambda contents: [{"n": len(c)} if c else ValueError("empty") for c in contents]

    got = {r.source_id: (r.n, r.error) for r in images.analyze(df, load, "n long").collect()}
    assert got["a"] == (2, None) and got["b"][1] == "ValueError: empty"


def test_identity_helpers(spark):
    df = spark.createDataFrame([("/r/a/b.jpg", "P1"), ("/r/../x", "P2")], "path string, display_id string")
    row = df.select(identity.relative("path", "/r").alias("a"), identity.resolved("display_id", "/r").alias("b"), identity.inside("path", "/r").alias("c"), identity.artifact_paths("display_id", Config()).alias("d")).collect()
    assert row[0].a == "a/b.jpg" and row[0].b == "/r/P1" and row[0].c and not row[1].c and len(row[0].d) == 10
    events = identity.with_event_defaults(spark.createDataFrame([(None, "x")], "event_type string, display_id string"), "decision", F.lit(5)).first()
    assert events.event_type == "decision" and events.created_at == 5 and events.event_id
    exif = spark.createDataFrame([('{"Make": "M", "ISO": 100}',)], "raw string").select(identity.exif_fields("raw").alias("e")).first().e
    assert (exif.make, exif.iso, exif.model) == ("M", "100", None)


def test_small_helpers(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    assert stats.drawn(df, 2.0).count() >= 0
    assert incremental.cached({"status": "success", "schema_version": "1", "input_hash": "h"}, "h", "1")["cache_hit"]
    assert incremental.cached({"status": "success", "schema_version": "1", "input_hash": "x"}, "h", "1") is None
    status = spark.createDataFrame([({"metadata": "success"},)], "s map<string, string>")
    assert status.select(incremental.ready("s", "preview").alias("a"), incremental.ready("s", "thumb").alias("b")).first() == (True, False)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from siftgrain.operators.store import shared_folder

    spark = N(conf=N(get=lambda k, d=None: d), sparkContext=N(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(spark)


def test_one_sidecar_of_those_that_differ_in_case(spark):
    photos = spark.createDataFrame([("a", "/r/a.jpg"), ("b", "/r/b.jpg")], "display_id string, source string")
    inventory = spark.createDataFrame([("/r/a.jpg", 1), ("/r/a.xmp", 2), ("/r/a.XMP", 3), ("/r/b.XMP", 4)], "path string, size long")
    ops = staging.plan(photos, photos.filter("false"), inventory, "/r", Config()).filter("outcome = 'move_sidecar'")
    assert sorted((r.display_id, r.source, r.bytes) for r in ops.collect()) == [("a", "/r/a.xmp", 2), ("b", "/r/b.XMP", 4)]


def test_stage_dependencies():
    from siftgrain.config import DEPENDS

    assert DEPENDS["image_metrics"] == ("preview", "person_mask") and DEPENDS["preview"] == () and incremental._upstream("image_metrics") == {"preview", "person_mask", "face"}


def test_pictures_are_resized_by_cubic_convolution():
    rng = np.random.default_rng(4)
    g = rng.integers(0, 256, (40, 64)).astype(float)
    assert (images.resized(g, 40, 64) == g).all() and images.resized(np.full((30, 50), 90.0), 8, 9).tolist() == np.full((8, 9), 90.0).tolist()
    # one value by definition: columns shrink by 8, so the kernel is 32 wide
    row = g[3]
    x = np.abs((np.arange(64) + 0.5 - 2.5 * 8) / 8)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    assert images.resized(g, 40, 8)[3, 2] == min(255, max(0, np.floor((w * row).sum() / w.sum() + 0.5)))
