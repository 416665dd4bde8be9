"""Page features: histograms and edges to quality, confidence, scale and mode ranking.

Only ``pixel_features`` touches pixels, in a vectorised helper; everything else is columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import once

TARGET, LEAST_SCALE, MOST_SCALE, MOST_PIXELS, PADDING = 2200, 1.5, 4.0, 30_000_000, 160
SMALL_SIDE, LAYOUT_SIDE = 300, 600
PIXELS_AT_ONCE = 1 << 21


def gray_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    b, g, r = (pixels[:, :, k].astype(np.int64) for k in range(3))
    return ((1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14).astype(np.uint8)


def reduced(x: np.ndarray, new: int) -> np.ndarray:
    """``x`` (images, cells, other side) with ``new`` cells along the second axis: means of what each new cell covers,
    from running sums, so the work is that of one pass whatever the sizes."""
    old = x.shape[1]
    edge = np.arange(new + 1) * (old / new)
    whole = np.minimum(edge.astype(np.int64), old - 1)
    sums = np.zeros((len(x), old + 1, x.shape[2]))
    np.cumsum(x, axis=1, out=sums[:, 1:])
    at = sums[:, whole] + (edge - whole)[None, :, None] * x[:, whole]
    return np.diff(at, axis=1) * (new / old)


def grown(x: np.ndarray, new: int) -> np.ndarray:
    """``x`` with more cells along the second axis, by linear interpolation between cell centres."""
    old = x.shape[1]
    at = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
    low = np.minimum(at.astype(np.int64), max(old - 2, 0))
    share = (at - low)[None, :, None]
    return x[:, low] * (1 - share) + x[:, np.minimum(low + 1, old - 1)] * share


def resized(grays: np.ndarray, height: int, width: int) -> np.ndarray:
    """Images of one shape (images, height, width), or a single one, in a new shape."""
    if grays.ndim == 2:
        return resized(grays[None], height, width)[0]
    x = grays.astype(float)
    for new in (height, width):  # one side, then the other
        x = (reduced if new <= x.shape[1] else grown)(x, new).transpose(0, 2, 1)
    return np.rint(x).clip(0, 255).astype(np.uint8)


def laplacian_variance(gray: np.ndarray) -> float:
    p = np.pad(gray.astype(float), [(1, 1) if n > 1 else (0, 0) for n in gray.shape], mode="reflect")
    if gray.shape[0] < 2:
        p = np.pad(p, [(1, 1), (0, 0)], mode="edge")
    if gray.shape[1] < 2:
        p = np.pad(p, [(0, 0), (1, 1)], mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def pixel_features(images: DataFrame, resize: bool = True) -> DataFrame:
    """image_id, height, width, hist (256 counts), laplacian_var, layout_hist. ``images``: image_id and ``image``.

    Images of one shape are reduced together, at most ``PIXELS_AT_ONCE`` pixels at a time (one image at least).
    """
    flat = images.select("image_id", "image.height", "image.width", "image.nChannels", "image.data")
    names = ["image_id", "height", "width", "hist", "laplacian_var", "layout_hist"]

    def some(rows: list, height: int, width: int) -> list[tuple]:
        grays = np.stack([gray_of(r.data, height, width, r.nChannels) for r in rows])
        small, layout = (resized(grays, SMALL_SIDE, SMALL_SIDE), resized(grays, min(height, LAYOUT_SIDE), min(width, LAYOUT_SIDE))) if resize else (grays, grays)
        counts = lambda x: np.bincount(x.ravel(), minlength=256).tolist()
        return [(r.image_id, height, width, counts(s), laplacian_variance(s), counts(y)) for r, s, y in zip(rows, small, layout, strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for (height, width), own in pdf.groupby(["height", "width"]):
                rows, step = list(own.itertuples(index=False)), max(1, PIXELS_AT_ONCE // (height * width))
                for lo in range(0, len(rows), step):
                    out += some(rows[lo : lo + step], height, width)
            yield pd.DataFrame(out, columns=names)

    return flat.mapInPandas(run, "image_id bigint, height int, width int, hist array<bigint>, laplacian_var double, layout_hist array<bigint>")


def hist_total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0).cast("long"), lambda a, n: a + n)


def moment(hist: Column, power: int) -> Column:
    """Sum of brightness to ``power`` over the histogram."""
    weighted = F.transform(hist, lambda n, i: n * F.pow(i.cast("double"), F.lit(power)))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x)


def entropy(hist: Column) -> Column:
    def terms(total: Column) -> Column:
        return F.aggregate(F.transform(hist, lambda n: F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)

    return once(hist_total(hist), terms)


def contrast(hist: Column) -> Column:
    total = hist_total(hist)
    return F.sqrt(F.greatest(moment(hist, 2) / total - F.pow(moment(hist, 1) / total, F.lit(2)), F.lit(0.0)))


def is_screenshot(laplacian_var: Column, entropy_: Column) -> Column:
    return (laplacian_var > 300) & (entropy_ < 6.8)


def quality_tier(screenshot: Column, sharpness: Column, contrast_: Column) -> Column:
    return F.when(screenshot & (sharpness > 500), "alta").when(((sharpness > 100) & (contrast_ > 30)) | (screenshot & (sharpness > 200)), "media").otherwise("baja")


def suggested_confidence(tier: Column, min_dim: Column) -> Column:
    base = F.when(tier == "alta", 15.0).when(tier == "media", 8.0).otherwise(3.0)
    return F.when(min_dim < 300, F.least(base, F.lit(3.0))).when(min_dim < 600, F.least(base, F.lit(5.0))).otherwise(base)


def image_quality(features: DataFrame) -> DataFrame:
    """All metrics of a page in one row; rules see unrounded values."""
    f = features.withColumn("e", entropy(F.col("hist"))).withColumn("c", contrast(F.col("hist")))
    f = f.withColumn("is_screenshot", is_screenshot(F.col("laplacian_var"), F.col("e"))).withColumn("min_dimension", F.least("width", "height"))
    f = f.withColumn("quality_tier", quality_tier(F.col("is_screenshot"), F.col("laplacian_var"), F.col("c")))
    return f.select(
        "image_id",
        "is_screenshot",
        "width",
        "height",
        (F.col("width").cast("long") * F.col("height")).alias("total_pixels"),
        "min_dimension",
        F.bround("laplacian_var", 1).alias("sharpness"),
        F.bround("e", 2).alias("entropy"),
        F.bround("c", 1).alias("contrast"),
        suggested_confidence(F.col("quality_tier"), F.col("min_dimension")).alias("suggested_confidence"),
        "quality_tier",
    )


def upscale_plan(images: DataFrame) -> DataFrame:
    """image_id, scale, new and padded sizes."""
    h, w = F.col("height").cast("double"), F.col("width").cast("double")
    side = F.least(h, w)
    scale = F.least(F.greatest(F.when(side > 0, TARGET / side).otherwise(3.0), F.lit(LEAST_SCALE)), F.lit(MOST_SCALE))
    capped = F.when(h * w * F.col("s") * F.col("s") > MOST_PIXELS, F.greatest(F.lit(LEAST_SCALE), F.least(F.col("s"), F.sqrt(MOST_PIXELS / (h * w))))).otherwise(F.col("s"))
    planned = images.withColumn("s", scale).withColumn("scale", capped)
    new_h, new_w = F.floor(h * F.col("scale")).cast("int"), F.floor(w * F.col("scale")).cast("int")
    return planned.select("image_id", "scale", new_h.alias("new_height"), new_w.alias("new_width"), (new_h + PADDING).alias("padded_height"), (new_w + PADDING).alias("padded_width"))


def otsu(hist: Column) -> Column:
    """The first threshold of greatest variance between the classes below (and at) it and above."""

    def best(sums: Column) -> Column:
        total, sum_all = sums["n"], sums["s"]

        def step(acc: Column, x: Column) -> Column:
            n, s = acc["n"] + x["n"], acc["s"] + x["n"] * x["i"]
            gap = s / n - (sum_all - s) / (total - n)
            between = F.when((x["n"] > 0) & (n < total), n * (total - n) * gap * gap).otherwise(0.0)
            return once(
                F.struct(n.alias("n"), s.alias("s"), between.alias("v")),
                lambda k: F.struct(k["n"].alias("n"), k["s"].alias("s"), F.greatest(k["v"], acc["best"]).alias("best"), F.when(k["v"] > acc["best"], x["i"]).otherwise(acc["t"]).cast("int").alias("t")),
            )

        bins = F.transform(hist, lambda n, i: F.struct(n.cast("double").alias("n"), i.alias("i")))
        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), F.lit(0).alias("t"))
        return F.aggregate(bins, start, step, lambda acc: acc["t"])

    return once(F.struct(hist_total(hist).cast("double").alias("n"), moment(hist, 1).alias("s")), best)


def text_density(hist: Column, threshold: Column) -> Column:
    """Share of pixels at or below the threshold."""
    return hist_total(F.slice(hist, F.lit(1), threshold + 1)) / hist_total(hist)


def segment_stats(segments: DataFrame) -> DataFrame:
    """Per page: skew from ``skew`` segments (median of flat angles, 0 if none), whether to turn the page, and the
    number of near-horizontal ``layout`` segments."""
    angle = F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")))
    flat = F.when((F.col("purpose") == "skew") & (F.abs("angle") < 15), F.col("angle"))
    stats = segments.withColumn("angle", angle).groupBy("image_id").agg(F.coalesce(F.percentile(flat, F.lit(0.5)), F.lit(0.0)).alias("skew"), F.count_if((F.col("purpose") == "layout") & (F.abs("angle") < 5)).alias("h_lines"))
    return stats.withColumn("turn", F.abs("skew").between(0.3, 10.0))


def block_count(contours: DataFrame, images: DataFrame) -> DataFrame:
    """Per page: contours over a two-thousandth of the reduced image."""
    area = F.least(F.col("height"), F.lit(LAYOUT_SIDE)) * F.least(F.col("width"), F.lit(LAYOUT_SIDE))
    held = images.select("image_id", "height", "width").join(contours.select("image_id", "area"), "image_id", "left")
    return held.groupBy("image_id").agg(F.count_if(F.col("area") > area * 0.0005).alias("n_blocks"))


def rank_psm(features: DataFrame) -> DataFrame:
    """Features with score_3, score_6 and ``psm_order``. Needs height, width, h_lines, text_density, n_blocks."""
    aspect = F.col("height") / F.greatest(F.col("width"), F.lit(1))
    many, density, n = F.col("h_lines") >= 5, F.col("text_density"), F.col("n_blocks")
    points = lambda *cases: sum_cases(cases)
    six = F.when(aspect > 2, 3).when(aspect > 1, 2).otherwise(0) + points((many, 2)) + F.when(density > 0.15, 2).when(density > 0.08, 1).otherwise(0) + points((n > 20, 1))
    three = points((aspect <= 1, 2), (many, 1), ((density > 0.08) & (density <= 0.15), 1), (n < 5, 1))
    scored = features.withColumn("score_3", three).withColumn("score_6", six)
    return scored.withColumn("psm_order", F.when(F.col("score_6") > F.col("score_3"), F.array(F.lit(6), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(6))))


def sum_cases(cases) -> Column:
    out = F.lit(0)
    for condition, value in cases:
        out = out + F.when(condition, value).otherwise(0)
    return out
