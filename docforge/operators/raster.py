"""Raster preparation on pixel tables: geometry, brightness, contrast, threshold.

Histograms have 256 rows an image; the windows over them and the joins with thresholds never see pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHORT_SIDE, TARGET_SIDE, MOST_UPSCALE = 1000, 1400, 2
CLIP, LEAST_SPAN = 0.005, 32


def nearest(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def canvas_side(c: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), nearest(c))


def image_scale(w: Column, h: Column, max_side: Column, upscale: bool = True) -> Column:
    """Small images grow, large ones shrink to the limit."""
    scale = F.when(F.least(w, h) < SHORT_SIDE, F.least(F.lit(float(MOST_UPSCALE)), F.lit(float(TARGET_SIDE)) / F.least(w, h))).otherwise(1.0) if upscale else F.lit(1.0)
    return _limited(scale, F.greatest(w, h), max_side)


def pdf_scale(w: Column, h: Column, dpi: Column, max_side: Column) -> Column:
    return _limited(dpi / F.lit(72.0), F.greatest(w, h), max_side)


def _limited(scale: Column, long: Column, max_side: Column) -> Column:
    return F.when(long * scale > max_side, scale * (max_side / (long * scale))).otherwise(scale)


def turned(w: Column, h: Column, rotation: Column, scale: Column) -> tuple[Column, Column]:
    """Sides of the canvas after rotation and scaling."""
    swap = F.pmod(rotation, F.lit(180)) == 90
    return canvas_side(F.when(swap, h).otherwise(w) * scale), canvas_side(F.when(swap, w).otherwise(h) * scale)


def rotate_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels (x, y) of images (w, h) turned clockwise by rotation; transparency is laid on white before, by ``strips.on_white``."""
    x, y, w, h, turn = (F.col(c) for c in ("x", "y", "w", "h", "rotation"))
    new_x = F.when(turn == 90, h - 1 - y).when(turn == 180, w - 1 - x).when(turn == 270, y).otherwise(x)
    new_y = F.when(turn == 90, x).when(turn == 180, h - 1 - y).when(turn == 270, w - 1 - x).otherwise(y)
    return pixels.withColumns({"x": new_x, "y": new_y})


def luma(pixels: DataFrame) -> DataFrame:
    """image_id, p, v: brightness, truncated."""
    return pixels.select("image_id", "p", F.expr("cast(r * 0.299D + g * 0.587D + b * 0.114D as int)").alias("v"))


def histogram(values: DataFrame) -> DataFrame:
    return values.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def contrast_bounds(hist: DataFrame) -> DataFrame:
    """image_id, lo, hi: where half a percent of the pixels is cut at either end; 0 and 255 for a flat image."""
    own = Window.partitionBy("image_id")
    total = F.sum("n").over(own)
    up = F.sum("n").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("n").over(own.orderBy("v").rowsBetween(0, Window.unboundedFollowing))
    marked = hist.select("image_id", "v", F.floor(total * CLIP).alias("cut"), up.alias("up"), down.alias("down"))
    ends = marked.groupBy("image_id").agg(F.min(F.when(F.col("up") > F.col("cut"), F.col("v"))).alias("lo"), F.max(F.when(F.col("down") > F.col("cut"), F.col("v"))).alias("hi"))
    flat = F.col("hi") - F.col("lo") < LEAST_SPAN
    return ends.select("image_id", F.when(flat, 0).otherwise(F.col("lo")).alias("lo"), F.when(flat, 255).otherwise(F.col("hi")).alias("hi"))


def stretched(v: Column, lo: Column, hi: Column) -> Column:
    """Brightness spread over the whole range, halves to even."""
    return F.rint(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - lo) * 255 / F.greatest(hi - lo, F.lit(1))))).cast("int")


def stretch(values: DataFrame, bounds: DataFrame) -> DataFrame:
    return values.join(bounds, "image_id").select("image_id", "p", stretched(F.col("v"), F.col("lo"), F.col("hi")).alias("v"))


def otsu(hist: DataFrame) -> DataFrame:
    """image_id, threshold: the lowest that separates best."""
    run = Window.partitionBy("image_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("image_id")
    mass = F.col("n") * F.col("v")
    h = hist.select("image_id", "v", F.sum("n").over(run).cast("double").alias("wb"), F.sum(mass).over(run).cast("double").alias("sb"), F.sum("n").over(own).cast("double").alias("t"), F.sum(mass).over(own).cast("double").alias("s"))
    wf = F.col("t") - F.col("wb")
    gap = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / wf
    h = h.where(F.col("wb") < F.col("t")).select("image_id", "v", (F.col("wb") * wf * gap * gap).alias("between")).where("between > 0")
    best = h.groupBy("image_id").agg(F.max(F.struct("between", (-F.col("v")).alias("v"))).alias("x")).select("image_id", (-F.col("x.v")).alias("threshold"))
    return hist.select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def binarize(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    return values.join(thresholds, "image_id").select("image_id", "p", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def enhance(pixels: DataFrame, contrast: bool = True, black_white: bool = False, gray: bool = True) -> DataFrame:
    """Pixels after the chosen steps, all channels alike; the table itself where none is chosen."""
    if not (contrast or black_white or gray):
        return pixels
    values = luma(pixels)
    if contrast:
        values = stretch(values, contrast_bounds(histogram(values)))
    if black_white:
        values = binarize(values, otsu(histogram(values)))
    return values.select("image_id", "p", *[F.col("v").alias(c) for c in ("r", "g", "b")])
