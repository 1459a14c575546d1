"""Kernels on decoded pictures (arrays), and the interface of analyzers that need a codec or a model.

A picture is struct<width int, height int, pixels array<short>>, rows of grey
or of red, green and blue values from 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_FIELDS = (
    "brightness_mean", "brightness_median", "brightness_p01", "brightness_p05", "brightness_p95", "brightness_p99", "shadow_clip_ratio", "highlight_clip_ratio", "dynamic_range_p05_p95",
    "contrast_std_ratio", "saturation_mean", "saturation_median", "saturation_clip_ratio", "value_mean", "color_cast_strength", "white_balance_deviation", "laplacian_var", "tenengrad", "edge_density",
    "center_laplacian_var", "center_tenengrad", "center_sharpness_ratio", "aspect_ratio", "center_brightness_mean", "center_brightness_delta", "noise_proxy", "gradient_anisotropy", "dominant_angle_deg",
    "rgb_mean_r", "rgb_mean_g", "rgb_mean_b", "color_cast_deviation_r", "color_cast_deviation_g", "color_cast_deviation_b",
)


def grey(rgb: np.ndarray) -> np.ndarray:
    """Luminance by the usual weights, in whole steps."""
    return np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5) if rgb.ndim == 3 else rgb.astype(float)


def _shifted(a: np.ndarray) -> np.ndarray:
    return np.pad(a, 1, mode="reflect") if min(a.shape) > 1 else np.pad(a, 1, mode="edge")


def laplacian_var(g: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian; 0 for an empty picture."""
    if not g.size:
        return 0.0
    p = _shifted(g)
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def sobel(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = _shifted(g)
    right, left = p[:, 2:], p[:, :-2]
    down, up = p[2:], p[:-2]
    return (right - left)[:-2] + 2 * (right - left)[1:-1] + (right - left)[2:], (down - up)[:, :-2] + 2 * (down - up)[:, 1:-1] + (down - up)[:, 2:]


def tenengrad(g: np.ndarray) -> float:
    """Mean squared gradient."""
    if not g.size:
        return 0.0
    x, y = sobel(g)
    return float((x * x + y * y).mean())


def edge_density(g: np.ndarray) -> float:
    """Share of edge pixels: local maxima of the gradient above 1.33 times the median, and those above 0.66 times it that touch one."""
    if not g.size:
        return 0.0
    x, y = sobel(g)
    size = np.abs(x) + np.abs(y)
    mid = float(np.median(g))
    low, high = int(max(0.0, 0.66 * mid)), int(min(255.0, 1.33 * mid))
    angle = (np.degrees(np.arctan2(y, x)) + 180) % 180
    p = _shifted(size)
    h, w = size.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    kinds = [(angle < 22.5) | (angle >= 157.5), (angle >= 22.5) & (angle < 67.5), (angle >= 67.5) & (angle < 112.5), (angle >= 112.5) & (angle < 157.5)]
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    top = np.zeros(size.shape, bool)
    for own, (dy, dx) in zip(kinds, steps, strict=True):
        top |= own & (size >= at(dy, dx)) & (size >= at(-dy, -dx))
    weak, strong = top & (size > low), top & (size > high)
    while True:
        q = np.pad(strong, 1)
        grown = weak & np.logical_or.reduce([q[1 + a : 1 + a + h, 1 + b : 1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        if (grown | strong).sum() == strong.sum():
            return float(strong.mean())
        strong |= grown


def motion_blur(g: np.ndarray) -> tuple[float, float]:
    """Anisotropy of the structure tensor and its dominant angle; zeros without gradients."""
    if not g.size:
        return 0.0, 0.0
    x, y = sobel(g)
    a, b, c = float((x * x).mean()), float((x * y).mean()), float((y * y).mean())
    if a + c <= 1e-9:
        return 0.0, 0.0
    return float(np.hypot(a - c, 2 * b) / (a + c)), float(np.degrees(0.5 * np.arctan2(2 * b, a - c)))


def noise_proxy(g: np.ndarray) -> float:
    """Deviation from a 5 by 5 Gaussian blur, as a share of the range, where the gradient is among the lowest 30 %."""
    if not g.size:
        return 0.0
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    p = np.pad(g, 2, mode="reflect") if min(g.shape) > 2 else np.pad(g, 2, mode="edge")
    rows = sum(k * p[i : i + g.shape[0]] for i, k in enumerate(kernel))
    blur = np.floor(sum(k * rows[:, i : i + g.shape[1]] for i, k in enumerate(kernel)) + 0.5)
    size = np.hypot(*sobel(g))
    return float((g - blur)[size <= np.percentile(size, 30)].std() / 255)


def metrics(rgb: np.ndarray) -> dict[str, float]:
    """The metrics of a picture, by METRIC_FIELDS; of an empty one all 0."""
    if not rgb.size:
        return dict.fromkeys(METRIC_FIELDS, 0.0)
    if rgb.ndim == 2:
        rgb = np.repeat(rgb[..., None], 3, axis=2)
    rgb = rgb.astype(float)
    g = grey(rgb)
    h, w = g.shape
    p01, p05, p50, p95, p99 = np.percentile(g, [1, 5, 50, 95, 99])
    top, low = rgb.max(2), rgb.min(2)
    saturation = np.floor(np.where(top > 0, 255 * (top - low) / np.maximum(top, 1e-9), 0.0) + 0.5)
    means = rgb.reshape(-1, 3).mean(0)
    center = g[int(h * 0.25) : int(h * 0.75), int(w * 0.25) : int(w * 0.75)]
    lap, center_lap = laplacian_var(g), laplacian_var(center)
    middle = center.mean() if center.size else 0.0
    anisotropy, angle = motion_blur(g)
    values = (
        g.mean(), p50, p01, p05, p95, p99, (g <= 4).mean(), (g >= 251).mean(), (p95 - p05) / 255,
        g.std() / 255, saturation.mean() / 255, np.median(saturation) / 255, (saturation >= 250).mean(), top.mean() / 255, np.linalg.norm(means - means.mean()) / 255, (means.max() - means.min()) / max(means.mean(), 1e-6), lap, tenengrad(g), edge_density(g),
        center_lap, tenengrad(center), (center_lap + 1e-6) / (lap + 1e-6), w / h, middle, middle - g.mean(), noise_proxy(g), anisotropy, angle, *means, *(means - means.mean()),
    )
    return dict(zip(METRIC_FIELDS, map(float, values), strict=True))


def _cubic(size: int, out: int) -> np.ndarray:
    """Weights (out, size) of cubic convolution (a = -1/2), as wide as the picture shrinks."""
    scale = size / out
    wide = max(1.0, scale)
    x = np.abs((np.arange(size) + 0.5 - (np.arange(out)[:, None] + 0.5) * scale) / wide)
    w = np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0.0))
    return w / w.sum(1, keepdims=True)


def resized(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey picture of another size by cubic convolution, first along rows, then along columns, each in whole steps from 0 to 255; of its own size it stays."""
    out = g.astype(float)
    if width != g.shape[1]:
        out = np.clip(np.floor(out @ _cubic(g.shape[1], width).T + 0.5), 0, 255)
    if height != g.shape[0]:
        out = np.clip(np.floor(_cubic(g.shape[0], height) @ out + 0.5), 0, 255)
    return out


def _hex(bits: np.ndarray) -> str:
    return "".join(f"{int(''.join('1' if b else '0' for b in bits.ravel()[k : k + 4]), 2):x}" for k in range(0, bits.size, 4))


def hashes(g: np.ndarray) -> dict[str, str]:
    """Average, difference and cosine-transform hashes of 64 bits, as hexadecimal digits."""
    small, wide = resized(g, 8, 8), resized(g, 8, 9)
    big, k = resized(g, 32, 32), np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / 64) * np.where(k == 0, 1 / 32, 1 / 16)[:, None] ** 0.5
    low = (basis @ big @ basis.T)[:8, :8]
    return {"ahash": _hex(small > small.mean()), "dhash": _hex(wide[:, 1:] > wide[:, :-1]), "phash": _hex(low > np.median(low.ravel()[1:]))}


def histograms(rgb: np.ndarray) -> dict[str, list[float]]:
    """Shares of 16 and 64 steps of brightness, and of 64 steps of each colour."""
    if rgb.ndim == 2:
        rgb = np.repeat(rgb[..., None], 3, axis=2)
    g, n = grey(rgb.astype(float)), max(1, rgb.shape[0] * rgb.shape[1])
    count = lambda a, bins: (np.histogram(a, bins=bins, range=(0, 256))[0] / n).tolist()
    return {"brightness_16": count(g, 16), "brightness": count(g, 64), "r": count(rgb[..., 0], 64), "g": count(rgb[..., 1], 64), "b": count(rgb[..., 2], 64)}


def decode(row: dict) -> np.ndarray:
    """A picture struct as an array of height, width and, for colours, 3."""
    a = np.asarray(row["pixels"], np.int16)
    n = row["width"] * row["height"]
    return a.reshape(row["height"], row["width"], 3) if n and a.size == 3 * n else a.reshape(row["height"], row["width"])


def _guarded(f: Callable[[dict], dict], names: tuple[str, ...], kind: T.DataType):
    """f over a column of structs, as a pandas UDF that gives (fields..., error); a failure doesn't end the task."""

    @F.pandas_udf(T.StructType([*(T.StructField(n, kind) for n in names), T.StructField("error", T.StringType())]))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append(f(row) | {"error": None})
                except Exception as e:  # noqa: BLE001  an unreadable picture is a result
                    rows.append(dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[*names, "error"])

    return run


image_metrics = _guarded(lambda row: metrics(decode(row)), METRIC_FIELDS, T.DoubleType())
image_histograms = _guarded(lambda row: histograms(decode(row)), ("brightness_16", "brightness", "r", "g", "b"), T.ArrayType(T.DoubleType()))
image_hashes = _guarded(lambda row: hashes(grey(decode(row))), ("ahash", "dhash", "phash"), T.StringType())


def analyze(photos: DataFrame, load: Callable[[], Callable[[list[bytes]], list[dict]]], schema: str, content: str = "content", key: str = "source_id", batch: int = 16) -> DataFrame:
    """(key, payload fields..., error) of a model or codec that runs on file contents.

    load makes the analyzer, once for each task; it takes a list of contents and
    gives a dict (or an exception) for each. A picture that fails has an error
    and no payload. This is the place for metadata, previews, faces, masks,
    embeddings and quality models.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyzer = load()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                found = analyzer(part[content].tolist())
                rows = [dict.fromkeys(names) | {"error": f"{type(r).__name__}: {r}"} if isinstance(r, Exception) else dict.fromkeys(names) | r | {"error": None} for r in found]
                yield pd.concat([part[[key]].reset_index(drop=True), pd.DataFrame(rows, columns=[*names, "error"])], axis=1)

    return photos.select(key, content).mapInPandas(run, f"{key} {photos.schema[key].dataType.simpleString()}, {schema}, error string")
