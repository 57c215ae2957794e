"""Image folders, parameter files, annotations, configuration.

Images are read by Spark's own image source, so any store that Spark reads will do.
What cannot be decoded is kept apart, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixel import base_name, parse_pair

SUFFIXES = ("png", "jpg", "jpeg")
PARAM_SCHEMA = "folder STRING, noise DOUBLE, nlm_h INT, nlm_tws INT, nlm_sws INT, gb_kernel STRING, clahe_cl DOUBLE, clahe_tgs STRING, thresh_bs INT, thresh_c DOUBLE, morphx_kernel STRING, kernel_open STRING, kernel_close STRING"
PAIRS = ("gb_kernel", "clahe_tgs", "morphx_kernel", "kernel_open", "kernel_close")


def image_paths(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, recursive: bool = False) -> DataFrame:
    """path, name of the image files of a folder, by path; suffixes are case-sensitive.  No file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).select("path")
    keep = F.lit(False)
    for s in suffixes:
        keep = keep | F.col("path").endswith("." + s)
    return files.filter(keep).select("path", base_name(F.col("path")).alias("name")).orderBy("path")


def read_images(spark: SparkSession, folder: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images, failures).  images: image_id (path), name, h, w, channels, data (bytes, BGR by rows); failures: path."""
    reader = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower())
    raw = reader.load(folder).select("image.*")
    good = raw.filter("height > 0").select(F.col("origin").alias("image_id"), base_name(F.col("origin")).alias("name"), F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("channels"), "data")
    return good, raw.filter("height <= 0").select(F.col("origin").alias("path"))


def _byte(i: Column) -> Column:
    return F.conv(F.hex(F.substring("data", (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


def gray_rasters(images: DataFrame) -> DataFrame:
    """image_id, h, w, px: gray values; three and four channels are weighed as BGR, one is taken as it is."""
    from ..functions.pixel import gray_from_bgr

    n = F.col("channels")
    level = lambda i: F.when(n == 1, _byte(i)).otherwise(gray_from_bgr(_byte(i * n), _byte(i * n + 1), _byte(i * n + 2)))
    return images.select("image_id", "h", "w", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), level).alias("px"))


def colour_rasters(images: DataFrame) -> DataFrame:
    """image_id, h, w, b, g, r: a raster for each channel of BGR images."""
    n = F.col("channels")
    plane = lambda k: F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: _byte(i * n + k))
    return images.filter("channels >= 3").select("image_id", "h", "w", plane(0).alias("b"), plane(1).alias("g"), plane(2).alias("r"))


def image_vectors(rasters: DataFrame, side: int = 128) -> DataFrame:
    """id, x: rasters resized to side x side, flattened row by row."""
    from ..operators.stencil import resize_nearest

    return resize_nearest(rasters, side, side).select(F.col("image_id").alias("id"), F.transform("px", lambda v: v.cast("double")).alias("x"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """Parameter rows of headerless CSV files with their order; pairs as struct<a, b>, blanks and signs allowed."""
    raw = spark.read.schema(PARAM_SCHEMA).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.withColumns({c: parse_pair(F.col(c)) for c in PAIRS}).withColumn("ord", F.monotonically_increasing_id())


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """name, label of JSON objects {name: label}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "label"))


def read_config(spark: SparkSession, path: str) -> dict:
    """A nested YAML file as a dict (one small file)."""
    import yaml

    return yaml.safe_load("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) or {}


def batches(vectors: DataFrame, size: int = 32) -> DataFrame:
    """batch, rows array<struct<id, x>>: vectors scaled to [0, 1] in batches of at most ``size``, in the order of the ids' hash."""
    parts = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    scaled = vectors.select("id", F.transform("x", lambda v: v / 255.0).alias("x"), parts.alias("h"))
    from pyspark.sql import Window

    # numbered inside hash slices, so no task sees all rows
    w = Window.partitionBy(F.floor(F.col("h") / 4096)).orderBy("h", "id")
    numbered = scaled.withColumn("slice", F.floor(F.col("h") / 4096)).withColumn("k", F.floor((F.row_number().over(w) - 1) / size))
    return numbered.groupBy("slice", "k").agg(F.collect_list(F.struct("id", "x")).alias("rows")).select(F.concat_ws("-", "slice", "k").alias("batch"), "rows")
