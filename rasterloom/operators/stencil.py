"""Neighbourhood operators on rasters (image_id, h, w, px: array, row by row).

Each is one or two passes of array functions over a raster's own row, so no pixel is
exchanged between tasks whatever the number of images.  Rows whose px is null give
null.  Borders: "none" leaves outside pixels out, "replicate" repeats the nearest
pixel, "reflect" mirrors without repeating the border pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _inside(x: Column, n: Column, border: str) -> Column:
    if border == "replicate":
        return F.greatest(F.lit(0), F.least(n - 1, x))
    if border == "reflect":
        x = F.abs(x)
        return F.when(n == 1, F.lit(0)).when(x > n - 1, 2 * (n - 1) - x).otherwise(x)
    return F.when((x >= 0) & (x < n), x)


def row_of(i: Column) -> Column:
    return F.floor(i / F.col("w")).cast("int")


def at(i: Column, dr: int, dc: int, border: str = "none", px: str = "px") -> Column:
    """The pixel dr rows and dc columns away from pixel i."""
    r, c = row_of(i), (i % F.col("w")).cast("int")
    r = _inside(r + dr, F.col("h"), border) if dr else r
    c = _inside(c + dc, F.col("w"), border) if dc else c
    place = (r * F.col("w") + c).cast("int")
    return F.get(px, place) if border != "none" else F.when(place.isNotNull(), F.get(px, place))


def _pass(df: DataFrame, pixel, out: str = "px") -> DataFrame:
    return df.withColumn(out, F.transform("px", lambda v, i: pixel(v, i)))


def _sides(k: int) -> range:
    """Offsets of a kernel of k pixels with its anchor at k // 2."""
    return range(-(k // 2), k - k // 2)


def gaussian_weights(k: int) -> list[float]:
    """Normalised weights of a kernel of k (odd) pixels; sigma follows the size: 0.3 ((k - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    raw = [math.exp(-((i - (k - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(k)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(df: DataFrame, k: int = 3, border: str = "reflect") -> DataFrame:
    """Separable Gaussian blur (doubles)."""
    weights = gaussian_weights(k)
    for vertical in (False, True):
        weigh = lambda v, i, vertical=vertical: sum((at(i, j if vertical else 0, 0 if vertical else j, border) * w for j, w in zip(_sides(k), weights, strict=True)), F.lit(0.0))
        df = _pass(df, weigh)
    return df


def adaptive_threshold(df: DataFrame, block: int = 15, c: float = 5.0) -> DataFrame:
    """Inverse adaptive threshold: 255 where a pixel is at most its Gaussian local mean less c, else 0."""
    blurred = gaussian_blur(df.withColumn("source", F.col("px")), block, "replicate")
    cut = lambda v, i: F.when(F.get("source", i) <= F.round(v - c, 6), F.lit(255)).otherwise(F.lit(0))
    return _pass(blurred, cut).drop("source")


def _extreme(df: DataFrame, kernel: tuple[int, int], pick) -> DataFrame:
    """Row pass and column pass of a rectangular kernel (rows, columns); pixels outside do not count."""
    for vertical, k in ((False, kernel[1]), (True, kernel[0])):
        if k > 1:
            df = _pass(df, lambda v, i, vertical=vertical, k=k: pick(*[at(i, j if vertical else 0, 0 if vertical else j) for j in _sides(k)]))
    return df


def dilate(df: DataFrame, kernel: tuple[int, int]) -> DataFrame:
    return _extreme(df, kernel, F.greatest)


def erode(df: DataFrame, kernel: tuple[int, int]) -> DataFrame:
    return _extreme(df, kernel, F.least)


def morph_close(df: DataFrame, kernel: tuple[int, int] = (3, 3)) -> DataFrame:
    return erode(dilate(df, kernel), kernel)


def morph_open(df: DataFrame, kernel: tuple[int, int] = (3, 3)) -> DataFrame:
    return dilate(erode(df, kernel), kernel)


def remove_noise(df: DataFrame, open_kernel: tuple[int, int] = (2, 2), close_kernel: tuple[int, int] = (3, 3)) -> DataFrame:
    return morph_close(morph_open(df, open_kernel), close_kernel)


def sobel_std(df: DataFrame, cut: int = 127) -> DataFrame:
    """image_id, edge_std: population standard deviation of the Sobel magnitude of the thresholded raster.

    Kernels are divided by 4, the magnitude is sqrt((gx^2 + gy^2) / 2), border pixels are repeated.
    """
    df = _pass(df, lambda v, i: F.when(v > cut, F.lit(255.0)).otherwise(F.lit(0.0)))

    def magnitude(v: Column, i: Column) -> Column:
        n = {(a, b): at(i, a, b, "replicate") for a in (-1, 0, 1) for b in (-1, 0, 1)}
        gx = (n[-1, 1] + 2 * n[0, 1] + n[1, 1] - n[-1, -1] - 2 * n[0, -1] - n[1, -1]) / 4
        gy = (n[1, -1] + 2 * n[1, 0] + n[1, 1] - n[-1, -1] - 2 * n[-1, 0] - n[-1, 1]) / 4
        return F.sqrt((gx * gx + gy * gy) / 2)

    df = _pass(df, magnitude, "edge")
    n = F.size("edge")
    total = lambda f: F.aggregate("edge", F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumn("mean", total(lambda x: x) / n)
    return df.select("image_id", F.sqrt(total(lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / n).alias("edge_std"))


#: Junction patterns around an on-pixel, as (row, column) offsets that must all be on (fixed values).
JUNCTIONS = (
    ((-1, 0), (0, 1), (1, 0), (0, -1)),
    ((-1, -1), (-1, 1), (1, 0)),
    ((-1, 1), (1, 1), (0, -1)),
    ((1, 1), (1, -1), (-1, 0)),
    ((1, -1), (-1, -1), (0, 1)),
    ((-1, 0), (0, -1), (1, 1)),
    ((0, 1), (-1, 0), (1, -1)),
    ((1, 0), (0, 1), (-1, -1)),
    ((0, -1), (1, 0), (-1, 1)),
    ((-1, -1), (-1, 1), (1, 1)),
    ((-1, 1), (1, 1), (1, -1)),
    ((1, 1), (1, -1), (-1, -1)),
    ((1, -1), (-1, -1), (-1, 1)),
)


def junction_mask(df: DataFrame) -> DataFrame:
    """1 where a pixel is on and its neighbours hold a junction pattern; pixels outside count as on.

    A plain T of three orthogonal neighbours is no pattern.
    """

    def hit(v: Column, i: Column) -> Column:
        on = {(a, b): F.coalesce(at(i, a, b) > 0, F.lit(True)) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)}
        some = F.lit(False)
        for pattern in JUNCTIONS:
            every = F.lit(True)
            for offset in pattern:
                every = every & on[offset]
            some = some | every
        return F.when((v > 0) & some, 1).otherwise(0)

    return _pass(df, hit)


def on_points(df: DataFrame) -> DataFrame:
    """image_id, h, w, points: the on-pixels row by row as array<struct<r, c>>."""
    found = F.filter(F.transform("px", lambda v, i: F.when(v > 0, F.struct(row_of(i).alias("r"), (i % F.col("w")).cast("int").alias("c")))), lambda p: p.isNotNull())
    return df.select("image_id", "h", "w", found.alias("points"))


def neighbours(df: DataFrame) -> DataFrame:
    """image_id, r, c, ord, nr, nc: the on-pixels around every on-pixel in row-major order."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    around = lambda i: F.array(*[F.when(at(i, a, b) > 0, F.struct(F.lit(k).alias("ord"), (row_of(i) + a).alias("nr"), ((i % F.col("w")).cast("int") + b).alias("nc"))) for k, (a, b) in enumerate(steps)])
    per = F.transform("px", lambda v, i: F.when(v > 0, F.filter(around(i), lambda x: x.isNotNull())))
    flat = df.select("image_id", "w", F.posexplode_outer(per).alias("i", "n")).filter("n is not null").select("image_id", row_of(F.col("i")).alias("r"), (F.col("i") % F.col("w")).cast("int").alias("c"), F.explode_outer("n").alias("n")).filter("n is not null")
    return flat.select("image_id", "r", "c", "n.ord", "n.nr", "n.nc")


def resize_nearest(df: DataFrame, h: int, w: int) -> DataFrame:
    """Every pixel of the new raster takes the source pixel under its upper left corner."""
    place = lambda i: (F.floor(F.floor(i / w) * F.col("h") / h) * F.col("w") + F.floor((i % w) * F.col("w") / w)).cast("int")
    out = df.withColumn("new", F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.get("px", place(i))))
    return out.select("image_id", F.lit(h).alias("h"), F.lit(w).alias("w"), F.col("new").alias("px"))


def resize_mean(df: DataFrame, by: int) -> DataFrame:
    """Mean of every by x by square; rows and columns that do not fill one are dropped."""
    nh, nw = F.floor(F.col("h") / by).cast("int"), F.floor(F.col("w") / by).cast("int")
    start = lambda i: (F.floor(i / nw) * by * F.col("w") + (i % nw) * by).cast("int")
    mean = lambda i: sum((F.get("px", (start(i) + a * F.col("w") + b).cast("int")) for a in range(by) for b in range(by)), F.lit(0.0)) / (by * by)
    out = df.withColumn("new", F.transform(F.sequence(F.lit(0), nh * nw - 1), mean))
    return out.select("image_id", nh.alias("h"), nw.alias("w"), F.col("new").alias("px"))


def rotate_nearest(df: DataFrame, degrees: Column, pad: int = 0) -> DataFrame:
    """Rotates by degrees (counter-clockwise, rows pointing down) about (w // 2, h // 2), nearest pixel, border repeated; then
    adds a black frame of pad pixels."""
    a = F.radians(degrees)
    df = df.withColumn("cos_", F.cos(a)).withColumn("sin_", F.sin(a))
    cx, cy = F.floor(F.col("w") / 2), F.floor(F.col("h") / 2)

    def source(v: Column, i: Column) -> Column:
        x, y = (i % F.col("w")) - cx, row_of(i) - cy
        sx = F.floor(F.round(F.col("cos_") * x - F.col("sin_") * y + cx, 6) + 0.5).cast("int")
        sy = F.floor(F.round(F.col("sin_") * x + F.col("cos_") * y + cy, 6) + 0.5).cast("int")
        return F.get("px", (_inside(sy, F.col("h"), "replicate") * F.col("w") + _inside(sx, F.col("w"), "replicate")).cast("int"))

    df = _pass(df, source).drop("cos_", "sin_")
    if not pad:
        return df
    nw, nh = F.col("w") + 2 * pad, F.col("h") + 2 * pad
    r, c = (lambda i: F.floor(i / nw) - pad), (lambda i: (i % nw) - pad)
    framed = F.transform(F.sequence(F.lit(0), nw * nh - 1), lambda i: F.when((r(i) >= 0) & (r(i) < F.col("h")) & (c(i) >= 0) & (c(i) < F.col("w")), F.get("px", (r(i) * F.col("w") + c(i)).cast("int"))).otherwise(F.lit(0)))
    return df.withColumn("new", framed).select("image_id", nh.cast("int").alias("h"), nw.cast("int").alias("w"), F.col("new").alias("px"))
