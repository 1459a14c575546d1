"""Scalar functions as Column expressions; all of them stay inside Catalyst."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def finite(x: ColumnOrName, default: float | None = None) -> Column:
    """x as a double, or the default where it is no number, NaN or infinite."""
    v = _c(x).try_cast("double")
    # NaN sorts above all numbers, and so fails as infinity does
    return F.when(F.abs(v) <= F.lit(sys.float_info.max), v).otherwise(F.lit(default).cast("double"))


def clamp(x: ColumnOrName, low: float, high: float) -> Column:
    """x between low and high; 0 first where x is no finite number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), finite(x, 0.0)))


def clamp01(x: ColumnOrName) -> Column:
    """x between 0 and 1; 0 where it is no finite number."""
    return clamp(x, 0.0, 1.0)


def weighted(items: list[tuple[ColumnOrName, ColumnOrName | float]]) -> Column:
    """Mean of clamped values by weight; items without weight don't count, and without any the mean is 0."""
    weights = [F.when(_c(w) > 0, _c(w)).otherwise(F.lit(0.0)) for _, w in items]
    total = sum(weights[1:], weights[0])
    values = [clamp01(v) * w for (v, _), w in zip(items, weights, strict=True)]
    return F.when(total > 0, clamp01(sum(values[1:], values[0]) / total)).otherwise(F.lit(0.0))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Cosine in double precision, not clamped; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def l2_normalize(a: ColumnOrName) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n)).otherwise(F.transform(_c(a), lambda x: x.cast("double")))


def vector_stats(a: ColumnOrName) -> Column:
    """struct(l2_norm, mean, std (of the population), min, max, finite_ratio)."""
    v, n = F.transform(_c(a), lambda x: x.cast("double")), F.size(_c(a))
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / n
    good = F.size(F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))) / n
    spread = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean))
    return F.struct(norm(a).alias("l2_norm"), mean.alias("mean"), spread.alias("std"), F.array_min(v).alias("min"), F.array_max(v).alias("max"), good.alias("finite_ratio"))


def log_ratio(x: ColumnOrName, full: float) -> Column:
    """log1p(x) / log1p(full), between 0 and 1."""
    return clamp01(F.log1p(F.greatest(F.lit(0.0), finite(x, 0.0))) / F.log1p(F.lit(full)))


def orientation(width: ColumnOrName, height: ColumnOrName) -> Column:
    w, h = _c(width), _c(height)
    return F.when(w > 1.1 * h, "landscape").when(h > 1.1 * w, "portrait").otherwise("squareish")


def aesthetic(score: ColumnOrName) -> Column:
    return clamp01(finite(score) / 10)


def eye_geometry(left: ColumnOrName, right: ColumnOrName) -> Column:
    """struct(eye_distance, eye_angle_deg, alignment_score) of two points [x, y]."""
    dx, dy = _c(right)[0] - _c(left)[0], _c(right)[1] - _c(left)[1]
    angle = F.degrees(F.atan2(dy, dx))
    return F.struct(F.hypot(dx, dy).alias("eye_distance"), angle.alias("eye_angle_deg"), (1 - F.least(F.abs(angle), F.lit(45.0)) / 45).alias("alignment_score"))


def anisotropy(jxx: ColumnOrName, jxy: ColumnOrName, jyy: ColumnOrName) -> Column:
    """struct(gradient_anisotropy, dominant_angle_deg) of a structure tensor; zeros without gradients."""
    a, b, c = _c(jxx), _c(jxy), _c(jyy)
    trace = a + c
    root = F.sqrt(F.greatest(F.lit(0.0), (a - c) * (a - c) + 4 * b * b))
    some = trace > 1e-9
    return F.struct(
        F.when(some, root / trace).otherwise(0.0).alias("gradient_anisotropy"),
        F.when(some, F.degrees(F.atan2(2 * b, a - c)) / 2).otherwise(0.0).alias("dominant_angle_deg"),
    )


def short_hash(x: ColumnOrName, n: int = 20) -> Column:
    return F.substring(F.sha1(_c(x).cast("binary")), 1, n)


def source_id(rel_path: ColumnOrName) -> Column:
    """The identity of a file: 20 hexadecimal digits of the SHA-1 of its relative path."""
    return short_hash(rel_path, 20)


def sanitize_display_id(stem: ColumnOrName, extension: ColumnOrName, file_name: ColumnOrName) -> Column:
    """stem_EXT with runs of other characters than letters, digits, '.', '_' and '-' as '_', and none of '._-' around.

    A file without a stem is a `photo`, one without an extension a `FILE`; where nothing is left, part of the name's hash names it.
    """
    first = F.coalesce(F.nullif(F.trim(_c(stem)), F.lit("")), F.lit("photo"))
    ext = F.coalesce(F.nullif(F.upper(F.ltrim(_c(extension), F.lit("."))), F.lit("")), F.lit("FILE"))
    out = F.btrim(F.regexp_replace(F.concat(first, F.lit("_"), ext), "[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.when(out == "", F.concat(F.lit("photo_"), short_hash(file_name, 8))).otherwise(out)


def safe_name(x: ColumnOrName) -> Column:
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}._-]", "_")


def append_error(*parts: ColumnOrName) -> Column:
    """Messages joined by '; ', nulls and empty ones left out; null if none is left."""
    kept = F.filter(F.array(*[_c(p) for p in parts]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "; "))


def bytes_text(n: ColumnOrName) -> Column:
    """A size in B, KB, ..., with one decimal below 10 (of all but B); 0 B for what is no size."""
    units = ["B", "KB", "MB", "GB", "TB"]
    v = F.greatest(F.lit(0.0), finite(n, 0.0))
    step = F.least(F.lit(4), F.when(v >= 1, F.floor(F.log(v) / F.log(F.lit(1024.0)) + 1e-12)).otherwise(0)).cast("int")
    x = v / F.pow(F.lit(1024.0), step)
    text = F.when((x < 10) & (step > 0), F.format_string("%.1f", x)).otherwise(F.format_string("%.0f", x))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), step + 1))


def score_text(v: ColumnOrName) -> Column:
    """A score in hundredths; a dash where there is none."""
    n = F.floor(finite(v) * 100 + 0.5).cast("long")
    return F.when(n.isNull(), "—").otherwise(n.cast("string"))


def delta_text(v: ColumnOrName) -> Column:
    """A difference in hundredths with a plus if it is positive; null where there is none."""
    n = F.floor(finite(v) * 100 + 0.5).cast("long")
    return F.when(finite(v) > 0, F.concat(F.lit("+"), n.cast("string"))).otherwise(n.cast("string"))


def clip_text(shadow: ColumnOrName, highlight: ColumnOrName) -> Column:
    """Shares of clipped shadows and highlights in percent; null unless both are known."""
    s, h = finite(shadow) * 100, finite(highlight) * 100
    return F.when(s.isNotNull() & h.isNotNull(), F.format_string("阴影 %.1f%% · 高光 %.1f%%", s, h))


# Media types by extension.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif", "heic": "image/heic", "heif": "image/heif"}


def extension(path: ColumnOrName) -> Column:
    """The extension of a path, lower-cased, with its point; '' without one."""
    return F.lower(F.regexp_extract(_c(path), r"(?:^|/)[^/]*[^/.][^/]*(\.[^./]+)$", 1))


def mime(path: ColumnOrName) -> Column:
    ext = F.ltrim(extension(path), F.lit("."))
    out = F.lit(None).cast("string")
    for name, kind in MIME.items():
        out = F.coalesce(out, F.when(ext == name, kind))
    return F.coalesce(out, F.lit("application/octet-stream"))


def data_url(path: ColumnOrName, content: ColumnOrName) -> Column:
    return F.concat(F.lit("data:"), mime(path), F.lit(";base64,"), F.regexp_replace(F.base64(_c(content)), r"\s", ""))


def capture_time(text: ColumnOrName) -> Column:
    """A capture time without zone: what is ahead of a '+', in one of three forms; null if none fits."""
    raw = F.trim(F.split_part(_c(text), F.lit("+"), F.lit(1)))
    forms = ("yyyy:M:d H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s")
    shape = raw.rlike(r"^\d{4}[:-]\d{1,2}[:-]\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}$")
    return F.when(shape, F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)).cast("timestamp_ntz") for f in forms]))


def capture_text(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "yyyy:MM:dd HH:mm:ss")


def seconds_apart(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Distance of two times in seconds with fractions; 0 where one is null."""
    micros = F.timestamp_diff("MICROSECOND", _c(a), _c(b))
    return F.coalesce(F.abs(micros) / 1e6, F.lit(0.0))


def from_mtime(ns: ColumnOrName) -> Column:
    return F.timestamp_micros(F.floor(_c(ns) / 1000).cast("long")).cast("timestamp_ntz")


def hash_bits(bits: ColumnOrName) -> Column:
    """16 hexadecimal digits of 64 booleans, the first being the highest bit."""
    digit = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.aggregate(F.slice(_c(bits), i * 4 + 1, 4), F.lit(0), lambda s, x: s * 2 + x.cast("int")))
    return F.array_join(F.transform(digit, lambda d: F.substring(F.lit("0123456789abcdef"), d + 1, F.lit(1))), "")


def hamming(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Bits in which two 16-digit hexadecimal hashes differ."""

    def half(x: ColumnOrName, at: int) -> Column:
        return F.conv(F.substring(_c(x), at, 8), 16, 10).cast("long")

    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def histogram(values: ColumnOrName, bins: int, top: float = 256.0) -> Column:
    """Shares of the values in `bins` equal parts of [0, top)."""
    at = F.transform(_c(values), lambda x: F.least(F.lit(bins - 1), F.floor(x.cast("double") * bins / top)).cast("int"))
    n = F.greatest(F.lit(1), F.size(_c(values)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(at, lambda x: x == k)) / n)


def share(values: ColumnOrName, predicate) -> Column:
    """Share of an array's values that satisfy the predicate."""
    return F.size(F.filter(_c(values), predicate)) / F.greatest(F.lit(1), F.size(_c(values)))


def brightness_curve(p05: ColumnOrName, p50: ColumnOrName, p95: ColumnOrName, bins: int = 64) -> Column:
    """A bell around p50 over `bins` parts of [0, 256), with sum 1, for photos without a histogram."""
    wide = F.greatest(F.lit(18.0), (_c(p95) - _c(p05)) / 2.4)
    raw = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.exp(-0.5 * F.pow(((k + 0.5) * (256.0 / bins) - _c(p50)) / wide, F.lit(2.0))))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def merged(first: ColumnOrName, later: ColumnOrName) -> Column:
    """Two maps as one; the later one's values win."""
    kept = F.map_filter(_c(first), lambda k, v: ~F.map_contains_key(_c(later), k))
    return F.map_concat(kept, _c(later))


def without_nulls(m: ColumnOrName, digits: int | None = None) -> Column:
    out = F.map_filter(_c(m), lambda k, v: v.isNotNull())
    return out if digits is None else F.transform_values(out, lambda k, v: F.round(v, digits))


def texts(*items: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in items]))
