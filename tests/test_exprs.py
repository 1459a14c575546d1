import math

import pytest
from pyspark.sql import functions as F

from siftgrain.functions import exprs as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "want"), [(0.5, 0.5), (-1.0, 0.0), (2.0, 1.0), (math.nan, 0.0), (math.inf, 0.0), (None, 0.0), ("x", 0.0), ("0.25", 0.25)])
def test_clamp01(spark, value, want):
    assert one(spark, X.clamp01(F.lit(value))) == want


def test_finite_default(spark):
    assert one(spark, X.finite(F.lit(math.nan), 3.0)) == 3.0
    assert one(spark, X.finite(F.lit("inf"), 3.0)) == 3.0


def test_weighted(spark):
    assert one(spark, X.weighted([(F.lit(1.0), 0.25), (F.lit(-1.0), 0.75)])) == 0.25
    assert one(spark, X.weighted([(F.lit(1.0), 0.0)])) == 0.0


def test_cosine(spark):
    a, b, zero = (F.array(*map(F.lit, v)) for v in ([1.0, 0.0], [1.0, 1.0], [0.0, 0.0]))
    assert one(spark, X.cosine(a, b)) == pytest.approx(math.sqrt(0.5))
    assert one(spark, X.cosine(a, zero)) == 0.0
    assert one(spark, X.l2_normalize(zero)) == [0.0, 0.0]


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024:03:01 10:20:30", "2024-03-01 10:20:30"), ("2024-3-1 1:2:3+08:00", "2024-03-01 01:02:03"), ("2024-03-01T10:20:30", "2024-03-01 10:20:30"), ("0000:00:00 00:00:00", None), ("2024:03:01 10:20:30-05:00", None), ("2024:03:01 10:20:30.5", None), ("", None)],
)
def test_capture_time(spark, text, want):
    assert one(spark, X.capture_time(F.lit(text)).cast("string")) == want


def test_seconds_apart_has_fractions(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, X.seconds_apart(t("2024-01-01 00:00:00.25"), t("2024-01-01 00:00:02"))) == 1.75
    assert one(spark, X.seconds_apart(t("2024-01-01 00:00:00"), F.lit(None).cast("timestamp_ntz"))) == 0.0


def test_names(spark):
    clean = X.sanitize_display_id(F.lit("a b/ü"), F.lit(".jpg"), F.lit("a b/ü.jpg"))
    assert one(spark, clean) == "a_b__JPG"
    assert one(spark, X.sanitize_display_id(F.lit("..."), F.lit(""), F.lit("..."))) == "FILE"
    assert one(spark, X.sanitize_display_id(F.lit(" "), F.lit(".ü"), F.lit("x"))) == "photo"
    assert one(spark, X.safe_name(F.lit("ä b/c"))) == "ä_b_c"
    assert one(spark, X.append_error(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == "a; b"
    assert one(spark, X.extension(F.lit("/x/.DS_Store"))) == ""
    assert one(spark, X.extension(F.lit("/x.y/A.JPG"))) == ".jpg"


def test_hashes(spark):
    bits = F.array(*[F.lit(i % 3 == 0) for i in range(64)])
    want = f"{int(''.join('1' if i % 3 == 0 else '0' for i in range(64)), 2):016x}"
    assert one(spark, X.hash_bits(bits)) == want
    assert one(spark, X.hamming(F.lit("ffffffffffffffff"), F.lit("0000000000000000"))) == 64


def test_texts(spark):
    assert [one(spark, X.bytes_text(F.lit(n))) for n in (0, 500, 1024, 10240, 5 << 30)] == ["0 B", "500 B", "1.0 KB", "10 KB", "5.0 GB"]
    assert one(spark, X.score_text(F.lit(None).cast("double"))) == "—"
    assert one(spark, X.delta_text(F.lit(0.031))) == "+3"
    assert one(spark, X.delta_text(F.lit(-0.03))) == "-3" and one(spark, X.delta_text(F.lit(None).cast("double"))) is None
    assert one(spark, X.bytes_text(F.lit(-5))) == "0 B"
    assert one(spark, X.clip_text(F.lit(0.1), F.lit(0.02))) == "阴影 10.0% · 高光 2.0%" and one(spark, X.clip_text(F.lit(None).cast("double"), F.lit(0.02))) is None
    assert one(spark, X.mime(F.lit("a.HEIC"))) == "image/heic"
    assert one(spark, X.data_url(F.lit("a.png"), F.lit(bytes(range(70))))).startswith("data:image/png;base64,AAEC")


def test_maps_and_curves(spark):
    m = lambda **kw: F.create_map(*[F.lit(x) for kv in kw.items() for x in kv])
    assert one(spark, X.merged(m(a=1, b=2), m(b=3))) == {"a": 1, "b": 3}
    curve = one(spark, X.brightness_curve(F.lit(90.0), F.lit(100.0), F.lit(120.0)))
    assert len(curve) == 64 and sum(curve) == pytest.approx(1) and max(curve) == curve[24]


def test_eye_geometry_and_tensor(spark):
    got = one(spark, X.eye_geometry(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))))
    assert got.eye_distance == 5 and got.alignment_score == 0
    flat = one(spark, X.anisotropy(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert (flat.gradient_anisotropy, flat.dominant_angle_deg) == (0, 0)
