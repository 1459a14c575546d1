from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftgrain.config import Config
from siftgrain.operators import contract, grouping, ranking, scoring
from siftgrain.operators.components import components
from siftgrain.plans.review import review

START = datetime(2024, 1, 1, 12)
KIND = "photo_no long, display_id string, capture_time timestamp_ntz, make string, model string, embedding array<double>, fg array<double>, bg array<double>, area double"


def photos(spark, seconds, **columns):
    rows = []
    for i, s in enumerate(seconds):
        own = {k: v[i] for k, v in columns.items()}
        rows.append((i, f"P{i:03d}", None if s is None else START + timedelta(seconds=s), own.get("make"), own.get("model"), own.get("embedding", [1.0, 0.0]), own.get("fg"), own.get("bg"), own.get("area")))
    return spark.createDataFrame(rows, KIND)


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault((str(r.day), r.segment), []).append(r.display_id)
    return sorted(map(sorted, out.values()))


def test_gap_and_midnight_and_camera(spark):
    c = Config()
    assert len(parts(grouping.segments(photos(spark, [0, 3600]), c))) == 1
    assert len(parts(grouping.segments(photos(spark, [0, 3601]), c))) == 2
    assert len(parts(grouping.segments(photos(spark, [43199, 43200]), c))) == 2
    assert len(parts(grouping.segments(photos(spark, [0, 1], make=["a", None], model=["x", "x"]), c))) == 1
    assert len(parts(grouping.segments(photos(spark, [0, 1], make=["a", "b"], model=["x", "x"]), c))) == 2
    assert len(parts(grouping.segments(photos(spark, [None, None, 0]), c))) == 2


def test_neighbour_cap_and_window(spark):
    c = Config()
    pairs = grouping.band_pairs(grouping.segments(photos(spark, [0] * 42), c), c, ["photo_no"])
    got = {(r.a_photo_no, r.b_photo_no) for r in pairs.collect()}
    assert (0, 40) in got and (0, 41) not in got and len(got) == sum(min(40, 41 - i) for i in range(42))
    far = grouping.band_pairs(grouping.segments(photos(spark, [0, 1800, 1801]), c), c, [])
    assert {(r.a_display_id, r.b_display_id) for r in far.collect()} == {("P000", "P001"), ("P001", "P002")}


@pytest.mark.parametrize(
    ("g", "fg", "bg", "area", "edge", "veto"),
    [
        (0.86, None, None, None, True, None),
        (0.85, None, None, None, False, None),
        (0.95, (1.0, None), (1.0, None), None, True, None),
        (0.88, (1.0, None), (1.0, None), None, False, None),
        (1.0, (1.0, 1.0), (1.0, 0.5), 0.5, False, "background"),
        (1.0, (1.0, 0.4), (1.0, 1.0), 0.08, False, "foreground"),
        (1.0, (1.0, 0.4), (1.0, 1.0), 0.07, True, None),
    ],
)
def test_edge_decision(spark, g, fg, bg, area, edge, veto):
    unit = lambda c: None if c is None else [c, (1 - c * c) ** 0.5]
    role = lambda x: [None, None] if x is None else [unit(v) for v in x]
    own = photos(spark, [0, 1], embedding=[unit(1.0), unit(g + 1e-9 if g < 1 else g)], fg=role(fg), bg=role(bg), area=[area, area])
    c = Config()
    got = grouping.edge_decision(grouping.band_pairs(grouping.segments(own, c), c, ["embedding", "fg", "bg", "area"]), c).first()
    assert (got.edge, got.veto) == (edge, veto)


def test_components_of_chain_star_and_repeats(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] * 2 + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_hub_are_joined_by_broadcast(spark, monkeypatch):
    import siftgrain.operators.components as C

    monkeypatch.setattr(C, "FEW_LINKS", 0)
    monkeypatch.setattr(C, "LOCAL_LINKS", 16)
    pairs = [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(30)] + [(29, 500), (900, 901)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {**{k: 0 for p in pairs[:-1] for k in p}, 900: 900, 901: 900}


def test_sessions_are_the_same_for_any_number_of_ranges(spark):
    rows = [(f"p{k:03d}", START + timedelta(seconds=k * 1800 + (k % 7 == 0) * 9000 * (k // 7)) if k % 9 else None, "a" if k % 5 else None, "m" if k % 11 else "n") for k in range(200)]
    df = spark.createDataFrame(rows, "display_id string, capture_time timestamp_ntz, make string, model string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.display_id, str(r.day), r.segment, r.rn) for r in grouping.segments(df, Config()).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    # by definition
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or START, r[0]))
    want, prev, segment, rn = [], None, 0, 0
    for name, time, make, model in order:
        day = time and time.date()
        if prev is None or (prev[1] and prev[1].date()) != day:
            segment, rn = 0, 0
        elif time and prev[1] and (time - prev[1]).total_seconds() > 3600 or (make and prev[2] and (make, model) != prev[2:]):
            segment, rn = segment + 1, 0
        rn += 1
        want.append((name, str(day), segment, rn))
        prev = (name, time, make, model)
    assert found[0] == sorted(want)


def test_role_policy_golden(spark):
    sizes = [1] * 21 + [2] * 4 + [3] * 5 + [4] * 2 + [5] * 2 + [6, 7, 8, 30]
    rows = [(s, f"P{s}_{i}", 1 - i / 100) for s, n in enumerate(sizes) for i in range(n)]
    got = ranking.ranked(spark.createDataFrame(rows, "set_no long, display_id string, overall double"), Config())
    roles = {r.recommendation: r["count"] for r in got.groupBy("recommendation").count().collect()}
    assert len(rows) == 113 and len(sizes) == 38
    assert roles["keep_candidate"] == 38 and roles["alternate_keeper"] == 9 and roles["lower_ranked"] == 23
    assert sum(roles.values()) - 38 == 75


def features(spark, n):
    df = photos(spark, [60 * i for i in range(n)], embedding=[[1.0, 0.01 * i] for i in range(n)])
    none = {c: F.lit(None).cast("double") for c in scoring.METRICS}
    face = F.lit(None).cast("struct<area_ratio: double, sharpness: double, alignment: double, confidence: double>")
    return df.withColumns(none | {"laplacian_var": F.col("photo_no") * 10.0, "face": face, "face_count": F.lit(0), "has_metrics": F.lit(True)})


def test_review_keeps_its_contract(spark):
    r = review(features(spark, 12), Config())
    named = r.photos.join(r.sets.select("set_no", "review_set_id"), "set_no").withColumn("similarity_to_cover", F.lit(1.0))
    first = named.filter("rank = 1").select("set_no", F.col("display_id").alias("primary_id"), "keep_count")
    sets = r.sets.join(first, "set_no").join(r.queue.groupBy("set_no").agg(F.count("*").alias("challengers")), "set_no")
    assert contract.review_violations(named, sets, r.photos).count() == 0
    wrong = named.withColumn("recommendation", F.lit("alternate"))
    assert contract.review_violations(wrong, sets, r.photos.union(r.photos)).count() > 0
    assert r.summary().first().photos == 12
    assert r.documents().first().photos[0].rank == 1
    assert r.input_hash == review(features(spark, 12).repartition(3), Config()).input_hash
    assert r.input_hash != review(features(spark, 11), Config()).input_hash


def test_scores_of_missing_and_broken_values(spark):
    face = "struct<area_ratio: double, sharpness: double, alignment: double, confidence: double>"
    df = features(spark, 3).withColumn("shadow_clip", F.lit(float("nan"))).withColumn("face", F.lit(None).cast(face)).withColumn("face_count", F.lit(2))
    rows = scoring.explained(scoring.scored(df.withColumn("has_metrics", F.lit(False)))).collect()
    assert all(r.score_missing == ["technical_quality", "face_quality", "iqa", "composition"] and r.face_quality == 0.5 and 0 <= r.base_overall <= 1 for r in rows)


def test_largest_face_is_the_first_of_equal_ones(spark):
    df = spark.sql("SELECT array(named_struct('area_ratio', 0.1D, 'k', 1), named_struct('area_ratio', 0.3D, 'k', 2), named_struct('area_ratio', 0.3D, 'k', 3)) AS faces, array() AS none")
    assert df.select(scoring.largest_face("faces").alias("f")).first().f.k == 2


def test_group_normalisation_of_one_value_and_no_spread(spark):
    rows = [(1, 0.3, []), (2, 0.4, []), (2, 0.4, []), (3, 0.1, []), (3, 0.9, ["iqa"])]
    df = spark.createDataFrame(rows, "set_no long, iqa double, score_missing array<string>")
    got = sorted((r.set_no, r.n_iqa) for r in ranking.group_normalized(df, categories=("iqa",)).collect())
    assert got == [(1, 0.3), (2, 0.5), (2, 0.5), (3, 0.1), (3, 0.9)]


def test_row_numbers_and_command(spark, tmp_path):
    from siftgrain.__main__ import main
    from siftgrain.operators.stats import row_numbers

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(7)
    assert all(r.k + 1 == r.n for r in row_numbers(df, ["k"], "n").collect())
    features(spark, 5).write.parquet(str(tmp_path / "photos"))
    assert main(["review", str(tmp_path / "photos"), "--tables", str(tmp_path / "out"), "--progress", "quiet"], spark) == 0
    assert spark.read.json(str(tmp_path / "out/summary")).first().photos == 5
    assert spark.read.json(str(tmp_path / "out/review_sets")).first().review_set_id == "set_000001"
    assert main(["review", str(tmp_path / "none"), "--tables", str(tmp_path / "out"), "--progress", "quiet"], spark) == 2
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.jpg").write_bytes(b"x")
    spark.createDataFrame([("metadata", "1", "h")], "stage string, version string, config_hash string").write.parquet(str(tmp_path / "out/versions"))
    assert main(["preprocess", str(tmp_path / "lib"), "--tables", str(tmp_path / "out"), "--progress", "jsonl"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "out/todo")).count() == 1
    ids = [r.source_id for r in spark.read.parquet(str(tmp_path / "out/photos")).collect()]
    features(spark, 1).withColumn("source_id", F.lit(ids[0])).write.parquet(str(tmp_path / "out/features"))
    assert main(["run", str(tmp_path / "lib"), "--tables", str(tmp_path / "out"), "--skip-preprocess", "--progress", "quiet"], spark) == 0
    assert spark.read.json(str(tmp_path / "out/summary")).first().photos == 1


def test_foreground_enrichment(spark):
    df = spark.sql("SELECT named_struct('x', 1) AS image_metrics, named_struct('foreground_area_ratio', 0.2D, 'foreground_enhanced_area_ratio', 0.3D) AS person_mask")
    assert scoring.with_foreground(df).first().image_metrics.foreground.foreground_area_ratio == 0.2
    assert df.select(scoring.empty_features().alias("f")).first().f.iqa.value is None
