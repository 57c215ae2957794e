"""The main job: every image of a folder filtered with the parameters of its own folder and noise level.

One pass per raster in numpy, as each raster has kernels of its own: no pixel is
exchanged, and what fails on one image is kept with the image and its parameters
while the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import kernels, lookup, regions, stencil
from ..sources import sinks
from . import pipelines

#: Parameters of an image, in the order of the parameter files.
ARGUMENTS = tuple(name for name, _ in pixel.CALIBRATION[2:13])


def blur(x: np.ndarray, kernel: tuple[int, int], mode: str) -> np.ndarray:
    """Separable Gaussian blur; kernel: columns, rows."""
    for axis, k in ((1, kernel[0]), (0, kernel[1])):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k // 2)
        wide = np.pad(x, pad, mode=mode if x.shape[axis] > k // 2 or mode == "edge" else "edge")
        n = x.shape[axis]
        x = sum(w * np.take(wide, np.arange(i, i + n), axis=axis) for i, w in enumerate(stencil.gaussian_weights(k)))
    return x


def extreme(x: np.ndarray, kernel: tuple[int, int], pick, fill: float) -> np.ndarray:
    """Row and column pass of a rectangle (rows, columns) anchored at its middle; pixels outside do not count."""
    out = x
    for axis, k in ((1, kernel[1]), (0, kernel[0])):
        moved = [kernels.shifted(out[None], *((0, d) if axis else (d, 0)), fill)[0] for d in range(-(k // 2), k - k // 2)]
        out = pick.reduce(moved)
    return out


def close(x: np.ndarray, kernel: tuple[int, int]) -> np.ndarray:
    return extreme(extreme(x, kernel, np.maximum, -1), kernel, np.minimum, 256)


def opened(x: np.ndarray, kernel: tuple[int, int]) -> np.ndarray:
    return extreme(extreme(x, kernel, np.minimum, 256), kernel, np.maximum, -1)


def orientation(x: np.ndarray) -> float:
    """Direction of the first principal axis of the on-pixels' (row, column) in degrees, in (-90, 90], from whole-number sums as
    ``regions.orientation``; an error without two of them."""
    r, c = np.nonzero(x > 0)
    if len(r) < 2:
        raise ValueError("no orientation: fewer than two on-pixels")
    n, sum_r, sum_c = len(r), int(r.sum()), int(c.sum())
    both, apart = n * int((r * c).sum()) - sum_r * sum_c, n * int((r * r - c * c).sum()) - (sum_r * sum_r - sum_c * sum_c)
    return float(np.degrees(0.5 * np.arctan2(2 * (round(both / n**2, 9) + 0.0), round(apart / n**2, 9) + 0.0)))


def rotate(x: np.ndarray, degrees: float, pad: int = 10) -> np.ndarray:
    """Rotated (counter-clockwise, rows pointing down) about (w // 2, h // 2) by bicubic interpolation (a = -0.75) at exact
    positions, borders repeated, in a black frame."""
    h, w = x.shape
    a = np.radians(degrees)
    rows, columns = np.mgrid[0:h, 0:w]
    u, v = columns - w // 2, rows - h // 2
    sx, sy = np.round(np.cos(a) * u - np.sin(a) * v + w // 2, 9), np.round(np.sin(a) * u + np.cos(a) * v + h // 2, 9)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)

    def weight(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, (1.25 * t - 2.25) * t * t + 1, np.where(t < 2, ((-0.75 * t + 3.75) * t - 6) * t + 3, 0.0))

    total = np.zeros((h, w))
    for dy in range(-1, 3):
        for dx in range(-1, 3):
            total += weight(sy - (y0 + dy)) * weight(sx - (x0 + dx)) * x[np.clip(y0 + dy, 0, h - 1), np.clip(x0 + dx, 0, w - 1)]
    return np.pad(np.clip(np.rint(total), 0, 255), pad)


def junctions(x: np.ndarray, nearer_than: float = 5.0) -> list[tuple[int, int]]:
    """Junction points in row-major order, close ones merged into their centroid, without the frame."""
    on = x > 0
    near = {(a, b): kernels.shifted(on[None].astype(np.int8), a, b, 1)[0] > 0 for a in (-1, 0, 1) for b in (-1, 0, 1)}
    hit = on & np.logical_or.reduce([np.logical_and.reduce([near[o] for o in pattern]) for pattern in stencil.JUNCTIONS])
    left = np.argwhere(hit).astype(float)
    out = []
    while len(left):
        taken = np.sqrt(((left - left[0]) ** 2).sum(1)) < nearer_than
        r, c = np.rint(left[taken].mean(0)).astype(int).tolist()
        if 0 < r < x.shape[0] - 1 and 0 < c < x.shape[1] - 1:
            out.append((r, c))
        left = left[~taken]
    return out


def crop(x: np.ndarray, path: str, pads: tuple[int, int, int, int] = (15, 15, 25, 15), col_guard: int = 2, row_guard: int = 20, edge: int = 20, jump: int = 5) -> np.ndarray:
    """The skeleton cut by the rules of its path and to the padded bounds of its junctions (as ``pipelines.crop_full``)."""
    width = x.shape[1]
    for has, lacks, above, below, cut in regions.CROP_RULES:
        if all(p in path for p in has.split("+")) and not (lacks and lacks in path) and (above is None or width > above) and (below is None or width < below):
            x = x[:, : max(0, x.shape[1] - cut)]
    h, w = x.shape
    points = junctions(x) if w else []
    right, bottom = [c for _, c in points if c < w - col_guard], [r for r, _ in points if r < h - row_guard]
    if not right or not bottom:
        raise ValueError("no junctions to crop to")
    left, top = min(c for _, c in points), min(r for r, _ in points)
    counts = (x[:, edge : max(edge, w - edge)] > 0).sum(1)
    starts = [y for y in range(1, h) if counts[y] > max(1, jump) and counts[y - 1] == 0]
    top = starts[1] if len(starts) == 2 else top
    share = 0.35 if w > 1000 else 0.25 if 800 < w < 1000 else 0.15 if 600 < w < 800 else 0.0
    if "PL" in path and share and left > w * share:
        left = int(np.flatnonzero((x > 0).any(0))[0])
    out = x[max(0, top - pads[2]) : min(h, max(bottom) + pads[3]), max(0, left - pads[0]) : min(w, max(right) + pads[1])]
    if not out.size:
        raise ValueError("the crop is empty")
    return out


def stages(gray: np.ndarray, args: dict, path: str, **limits) -> Iterator[tuple[str, np.ndarray]]:
    """(name, raster) of every step from a gray raster to its cropped skeleton; limits: most, hole, pad, crop."""
    x = np.where((gray >= 245) & (gray <= 255), 190, gray).astype(float)
    yield "gray", x
    x = kernels.denoise_stack(x[None], args["nlm_h"], args["nlm_tws"], args["nlm_sws"])[0]
    yield "denoised", x
    x = np.rint(blur(x, args["gb_kernel"], "reflect"))
    yield "blurred", x
    x = kernels.clahe_stack(x[None], args["clahe_cl"], args["clahe_tgs"][::-1])[0]
    yield "enhanced_gray", x
    block = args["thresh_bs"]
    if block % 2 == 0 or block < 3:
        raise ValueError(f"block size {block} is not odd and above 1")
    x = np.where(x <= np.round(blur(x, (block, block), "edge") - args["thresh_c"], 6), 255, 0)
    yield "thresh", x
    x = close(x, args["morphx_kernel"])
    yield "closed_binary", x
    x = regions.small_mask_stack(x[None], limits.get("most", 1000))[0]
    yield "cleaned_binary", x
    x = opened(x, args["kernel_open"])
    yield "opened_image", x
    x = close(x, args["kernel_close"])
    yield "cleaned_image", x
    x = regions.fill_holes_stack(x[None], limits.get("hole", 300))[0]
    yield "output_image", x
    x = rotate(x.astype(float), -(orientation(x) - 90), limits.get("pad", 10))
    yield "rotated", x
    x = kernels.thin_stack(np.where(x >= 128, 255, 0)[None])[0]
    yield "skeleton", x
    yield "cropped_image", crop(x, path, **limits.get("crop", {}))


RESULT = "h int, w int, px array<int>, error string"


def process(images: DataFrame, **limits) -> DataFrame:
    """The columns of images with h, w, px of the cropped skeleton, or px null and the error.

    images: path, h, w, px (gray) and args (the parameters as JSON, null if there are none) beside others.
    """
    rest = [f for f in images.schema.fields if f.name not in ("h", "w", "px", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for path, h, w, px, args in zip(*(batch.column(c).to_pylist() for c in ("path", "h", "w", "px", "args")), strict=True):
                found, error = None, None
                try:
                    if px is None or not h or not w:
                        raise ValueError("the image could not be loaded")
                    if args is None:
                        raise ValueError("no parameters for the folder")
                    read = {k: (v["a"], v["b"]) if isinstance(v, dict) else v for k, v in json.loads(args).items()}
                    if missing := [k for k in ARGUMENTS if read.get(k) is None]:
                        raise ValueError("parameters missing: " + ", ".join(missing))
                    for _, found in stages(np.array(px, dtype=float).reshape(h, w), read, path, **limits):  # noqa: B007
                        pass
                except Exception as failure:  # one image's failure is its own
                    found, error = None, f"{type(failure).__name__}: {failure}"
                shape = (None, None) if found is None else found.shape
                for column, value in zip(out, (*shape, None if found is None else found.astype(int).ravel().tolist(), error), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), *(pa.array(c, type=t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string()), strict=True))], [*(f.name for f in rest), "h", "w", "px", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return images.mapInArrow(run, f"{schema}, {RESULT}")


def with_arguments(rasters: DataFrame, params: DataFrame, block: int = 15, c: float = 5.0) -> DataFrame:
    """rasters (image_id, path, h, w, px) with folder, noise and args: the parameters of the folder's row of nearest noise.

    A folder of params without rows, or an image without a noise level, gives null args.
    """
    noise = pipelines.noise_level(rasters, block, c)
    probed = rasters.select("image_id", "path", "h", "w", "px", pixel.region_code(F.col("path")).alias("folder")).join(noise, "image_id", "left")
    chosen = lookup.nearest_params(probed.select(F.col("image_id").alias("probe_id"), "folder", F.col("noise").alias("level")), params).select(F.col("probe_id").alias("image_id"), "ord")
    args = params.select("ord", F.to_json(F.struct(*ARGUMENTS)).alias("args"))
    return probed.join(chosen, "image_id", "left").join(args, "ord", "left").select("image_id", "path", "folder", "noise", "args", "h", "w", "px")


def filter_images(rasters: DataFrame, params: DataFrame, done: DataFrame | None = None, **limits) -> tuple[DataFrame, DataFrame]:
    """(skeletons, failures) of the images that are not among the finished ones (path).

    failures: path, error, noise, folder, args.  ``limits`` go to ``stages``, block and c of the noise level too.
    """
    level = {k: limits.pop(k) for k in ("block", "c") if k in limits}
    todo = rasters if done is None else lookup.unprocessed(rasters, done)
    out = process(with_arguments(todo, params, **level), **limits)
    return out.filter("error is null").drop("error", "args"), out.filter("error is not null").select("path", "error", "noise", "folder", "args")


def write_job(rasters: DataFrame, params: DataFrame, done: DataFrame | None, folder: str, log: str, **limits) -> dict[str, int]:
    """Writes the skeletons as PNG files under their base names and appends the failures to the log; counts of both."""
    good, bad = filter_images(rasters, params, done, **limits)
    written = sinks.write_image_files(good, pixel.base_name(F.col("path")), folder)
    bad.write.mode("append").json(log)
    return {"written": written, "failed": rasters.sparkSession.read.json(log).count()}


def calibration(spark: SparkSession, fields: dict[str, str]) -> DataFrame:
    """One row of a calibration's text fields in their kinds."""
    text = spark.createDataFrame([tuple(fields[name] for name, _ in pixel.CALIBRATION)], ", ".join(f"{name} string" for name, _ in pixel.CALIBRATION))
    return text.select(*[c.alias(name) for name, c in pixel.parse_args({name: F.col(name) for name, _ in pixel.CALIBRATION}).items()])


def calibrate_execute(spark: SparkSession, fields: dict[str, str], raster: DataFrame, **limits) -> DataFrame:
    """name, h, w, px of the steps named in debug_args, and of the result (cropped_image), for one image tried out.

    raster: h, w, px (gray) of the image; other rows are left out by path.
    """
    args = calibration(spark, fields).first()
    read = {k: tuple(args[k]) if isinstance(args[k], tuple) else args[k] for k in ARGUMENTS}
    one = raster.filter(F.col("path") == args["image_path"]).first()
    if one is None:
        raise ValueError(f"no image at {args['image_path']}")
    wanted = {*args["debug_args"], "cropped_image"}
    rows = [(name, *x.shape, x.astype(int).ravel().tolist()) for name, x in stages(np.array(one["px"], dtype=float).reshape(one["h"], one["w"]), read, args["image_path"], **limits) if name in wanted]
    return spark.createDataFrame(rows, "name string, h int, w int, px array<int>")


def calibrate_submit(spark: SparkSession, fields: dict[str, str], raster: DataFrame, path: str, block: int = 15, c: float = 5.0) -> DataFrame:
    """Appends folder, noise level and parameters of a calibrated image to the parameter files; the row."""
    args = calibration(spark, fields)
    mine = raster.join(args.select(F.col("image_path").alias("path")), "path", "left_semi")
    noise = pipelines.noise_level(mine, block, c).select("noise")
    row = args.crossJoin(F.broadcast(noise.limit(1))).select(F.col("folder_name").alias("folder"), "noise", *ARGUMENTS)
    sinks.append_params(row, path)
    return row
