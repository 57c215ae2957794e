"""Components, masks, orientation, crop bounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.fixtures import pixels
from .kernels import component_labels, components, raster_map


def component_stats(df: DataFrame) -> DataFrame:
    """image_id, label, x, y, width, height, size, cx, cy of every 8-connected component of on-pixels."""
    p = pixels(components(df)).filter("v > 0")
    return p.groupBy("image_id", F.col("v").alias("label")).agg(
        F.min("c").alias("x"),
        F.min("r").alias("y"),
        (F.max("c") - F.min("c") + 1).alias("width"),
        (F.max("r") - F.min("r") + 1).alias("height"),
        F.count("*").alias("size"),
        F.avg("c").alias("cx"),
        F.avg("r").alias("cy"),
    )


def small_mask_stack(stack: np.ndarray, most: int = 1000) -> np.ndarray:
    """Keeps pixels inside the box [x, x + width] x [y, y + height] (both ends in) of any component of at most ``most`` pixels."""
    labels = component_labels(stack)
    n, h, w = stack.shape
    inside = np.zeros_like(labels, dtype=bool)
    for k in range(n):
        size = np.bincount(labels[k].ravel(), minlength=h * w + 1)
        for label in np.flatnonzero(size[1:]) + 1:
            if size[label] <= most:
                r, c = np.nonzero(labels[k] == label)
                inside[k, r.min() : r.max() + 2, c.min() : c.max() + 2] = True
    return np.where(inside, stack, 0)


def small_component_mask(df: DataFrame, most: int = 1000) -> DataFrame:
    return raster_map(df, lambda stack: small_mask_stack(stack, most))


def fill_holes_stack(stack: np.ndarray, under: int = 300) -> np.ndarray:
    """255, but 0 where a pixel is in an off-component of at least ``under`` pixels."""
    labels = component_labels(255 - np.where(stack > 0, 255, 0))
    out = np.full_like(labels, 255)
    for k in range(len(stack)):
        size = np.bincount(labels[k].ravel())
        out[k][(labels[k] > 0) & (size[labels[k]] >= under)] = 0
    return out


def fill_small_holes(df: DataFrame, under: int = 300) -> DataFrame:
    return raster_map(df, lambda stack: fill_holes_stack(stack, under))


def small_component_count(df: DataFrame, under: int = 50) -> DataFrame:
    """image_id, n_small: components of fewer than ``under`` pixels (0 for an empty raster)."""
    s = component_stats(df).groupBy("image_id").agg(F.sum(F.when(F.col("size") < under, 1).otherwise(0)).alias("n_small"))
    return df.select("image_id").join(s, "image_id", "left").select("image_id", F.coalesce("n_small", F.lit(0)).cast("long").alias("n_small"))


def noisy_images(scores: DataFrame, score: str, over: float) -> DataFrame:
    return scores.filter(F.col(score) > over)


def orientation(df: DataFrame) -> DataFrame:
    """image_id, angle: direction of the first principal axis of the on-pixels' (row, column), degrees in (-90, 90].

    Closed form of the 2 x 2 covariance, from whole-number sums and rounded to nine digits: a covariance of 0 has no sign that
    would turn an axis of 90 degrees to -90.  Null without on-pixels.
    """
    p = pixels(df).filter("v > 0").select("image_id", F.col("r").cast("long"), F.col("c").cast("long"))
    total = {name: F.sum(x).cast("decimal(20,0)") for name, x in (("r", F.col("r")), ("c", F.col("c")), ("rc", F.col("r") * F.col("c")), ("rr_cc", F.col("r") * F.col("r") - F.col("c") * F.col("c")))}
    n = F.count("*")
    # n * n times the covariance and the difference of the variances
    both = n.cast("decimal(20,0)") * total["rc"] - total["r"] * total["c"]
    apart = n.cast("decimal(20,0)") * total["rr_cc"] - (total["r"] * total["r"] - total["c"] * total["c"])
    part = lambda x: F.round(x.cast("double") / (n.cast("double") * n), 9) + F.lit(0.0)
    return p.groupBy("image_id").agg(F.degrees(0.5 * F.atan2(2 * part(both), part(apart))).alias("angle"))


#: Columns cut off the right by the text of the path: (must hold, must not hold, width above, width below, columns) (fixed values).
CROP_RULES = (
    ("AT", None, None, None, 150),
    ("RO", None, None, None, 150),
    ("HU", "2019", None, None, 170),
    ("HU+2019", None, None, None, 100),
    ("MD", None, None, None, 100),
    ("PL", None, 1000, None, 400),
    ("PL", None, 800, 1000, 200),
    ("PL", None, 600, 800, 10),
)


def crop_columns(path: Column, width: Column) -> Column:
    """Columns that the rules cut off the right of a raster, all that apply added up."""
    total = F.lit(0)
    for has, lacks, above, below, cut in CROP_RULES:
        test = F.lit(True)
        for part in has.split("+"):
            test = test & path.contains(part)
        if lacks:
            test = test & ~path.contains(lacks)
        if above is not None:
            test = test & (width > above)
        if below is not None:
            test = test & (width < below)
        total = total + F.when(test, cut).otherwise(0)
    return total


def left_fallback(path: Column, width: Column) -> Column:
    """The left bound above which the leftmost pixel is used instead (0: never)."""
    share = F.when(width > 1000, 35).when((width > 800) & (width < 1000), 25).when((width > 600) & (width < 800), 15).otherwise(0)
    return F.when(path.contains("PL"), width * share / 100).otherwise(F.lit(0.0))


def junction_box(points: DataFrame, pad: tuple[int, int, int, int] = (15, 15, 25, 15), col_guard: int = 2, row_guard: int = 20) -> DataFrame:
    """image_id, x1, x2, y1, y2: bounds of the junctions, padded (left, right, top, bottom) and clamped; null without junctions.

    The right and lower bounds leave out junctions in the last columns and rows.  Columns border and leftmost of points, where
    they are there and not null, stand for the top and the left bound.
    """
    of = lambda f, keep=None: F.transform(F.filter("points", keep) if keep else F.col("points"), f)
    left, top = F.array_min(of(lambda p: p["c"])), F.array_min(of(lambda p: p["r"]))
    left = F.coalesce("leftmost", left) if "leftmost" in points.columns else left
    top = F.coalesce("border", top) if "border" in points.columns else top
    right = F.array_max(of(lambda p: p["c"], lambda p: p["c"] < F.col("w") - col_guard))
    bottom = F.array_max(of(lambda p: p["r"], lambda p: p["r"] < F.col("h") - row_guard))
    return points.select(
        "image_id",
        F.greatest(F.lit(0), left - pad[0]).alias("x1") if pad[0] >= 0 else left.alias("x1"),
        F.when(right.isNotNull(), F.least(F.col("w"), right + pad[1])).alias("x2"),
        F.greatest(F.lit(0), top - pad[2]).alias("y1"),
        F.when(bottom.isNotNull(), F.least(F.col("h"), bottom + pad[3])).alias("y2"),
    ).withColumn("x1", F.when(F.col("x2").isNotNull() & F.col("y2").isNotNull(), F.col("x1"))).withColumn("y1", F.when(F.col("x1").isNotNull(), F.col("y1")))


def crop(df: DataFrame, box: DataFrame) -> DataFrame:
    """Rasters cut to [y1, y2) x [x1, x2); null px (for quarantine) where the box is null or empty."""
    b = df.join(box, "image_id", "left").withColumn("nh", F.greatest(F.lit(0), F.col("y2") - F.col("y1"))).withColumn("nw", F.greatest(F.lit(0), F.col("x2") - F.col("x1")))
    rows = F.flatten(F.transform(F.sequence(F.col("y1"), F.col("y2") - 1), lambda y: F.slice("px", y * F.col("w") + F.col("x1") + 1, F.col("nw"))))
    px = F.when((F.col("nh") > 0) & (F.col("nw") > 0), rows)
    # named apart first: inside a lambda, w would be the new w of the same select
    return b.withColumn("cut", px).select("image_id", F.col("nh").alias("h"), F.col("nw").alias("w"), F.col("cut").alias("px"))


def raster_border(edge: int = 20, jump: int = 5) -> Column:
    """Of a raster's own row: the second of exactly two rows with more than one on-pixel, more than ``jump``, between the side
    edges whose row before has none; null otherwise."""
    row = lambda y: F.size(F.filter(F.slice("px", y * F.col("w") + edge + 1, F.greatest(F.lit(0), F.col("w") - 2 * edge)), lambda v: v > 0))
    counts = F.transform(F.sequence(F.lit(0), F.col("h") - 1), row)
    starts = F.filter(F.transform(counts, lambda n, y: F.when((y > 0) & (n > 1) & (n > jump) & (F.get(counts, y - 1) == 0), y)), lambda y: y.isNotNull())
    return F.when(F.size(starts) == 2, F.get(starts, F.lit(1)))


def raster_leftmost() -> Column:
    """Of a raster's own row: the first column with an on-pixel, 0 without."""
    columns = F.transform("px", lambda v, i: F.when(v > 0, (i % F.col("w")).cast("int")))
    return F.coalesce(F.array_min(columns), F.lit(0))


def upper_border(points: DataFrame, from_col: int, to_col: int, jump: int) -> DataFrame:
    """image_id, border: the second of exactly two rows where on-pixels start after an empty row; null otherwise.

    points: image_id, r, c of on-pixels; a row starts something if it has more than one on-pixel in [from_col, to_col), at
    least ``jump`` of them, and the row before has none.
    """
    per_row = points.filter((F.col("c") >= from_col) & (F.col("c") < to_col)).groupBy("image_id", "r").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id").orderBy("r")
    starts = per_row.withColumn("before", F.lag("r").over(w)).filter("r > 0 and n > 1").filter((F.col("n") >= jump) & F.coalesce(F.col("before") < F.col("r") - 1, F.lit(True)))
    per = starts.groupBy("image_id").agg(F.count("*").alias("k"), F.max("r").alias("last"))
    every = points.select("image_id").distinct()
    return every.join(per, "image_id", "left").select("image_id", F.when(F.col("k") == 2, F.col("last")).alias("border"))


def leftmost_pixel(points: DataFrame) -> DataFrame:
    return points.groupBy("image_id").agg(F.coalesce(F.min("c"), F.lit(0)).alias("leftmost"))
