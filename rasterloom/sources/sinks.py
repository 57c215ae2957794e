"""Where results go: partitioned tables, PNG files, parameter and model files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def png_bytes(px: list[int], h: int, w: int) -> bytes:
    """An 8-bit gray PNG."""
    raw = np.asarray(px, dtype=np.uint8).reshape(h, w)
    lines = b"".join(b"\0" + row.tobytes() for row in raw)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_png(rasters: DataFrame) -> DataFrame:
    """image_id, png of rasters, encoded on the executors; a null raster gives null."""

    def run(batches):
        for pdf in batches:
            pdf["png"] = [None if x is None else png_bytes(x, h, w) for x, h, w in zip(pdf["px"], pdf["h"], pdf["w"], strict=True)]
            yield pdf[["image_id", "png"]]

    schema = T.StructType([T.StructField("image_id", rasters.schema["image_id"].dataType), T.StructField("png", T.BinaryType())])
    return rasters.select("image_id", "h", "w", "px").mapInPandas(run, schema)


def write_images(rasters: DataFrame, name: Column, folder: str) -> None:
    """Writes rasters as a table of PNG bytes under their base names (name, png); each task writes its own part."""
    named = rasters.select("image_id", name.alias("name"))
    encode_png(rasters).join(named, "image_id").select("name", "png").write.mode("overwrite").parquet(folder)


def write_image_files(rasters: DataFrame, name: Column, folder: str) -> int:
    """Writes each raster as a PNG file of its own under its name, from the executors, and returns how many there are.

    The folder must be one that executors and driver share; a file is renamed into place, so a task that runs again leaves
    whole files.
    """

    def run(batches):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for pdf in batches:
            for label, png in zip(pdf["name"], pdf["png"], strict=True):
                part = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(part, "wb") as out:
                    out.write(png)
                os.replace(part, os.path.join(folder, label))
            yield pdf[["name"]]

    named = rasters.select("image_id", name.alias("name"))
    return encode_png(rasters).join(named, "image_id").filter("png is not null").select("name", "png").mapInPandas(run, "name string").count()


def write_by(df: DataFrame, part: Column, name: str, folder: str) -> None:
    """One folder per value: cluster_<id>, clean and noisy, normal and anomalous."""
    df.withColumn(name, part).write.mode("overwrite").partitionBy(name).parquet(folder)


def append_params(params: DataFrame, path: str) -> None:
    """Appends calibrated rows as headerless CSV, pairs as (a,b)."""
    from ..functions.pixel import format_pair

    pairs = {f.name: format_pair(F.col(f.name)) for f in params.schema.fields if isinstance(f.dataType, T.StructType)}
    params.drop("ord").withColumns(pairs).write.mode("append").csv(path)


def error_log(df: DataFrame, folder: str) -> DataFrame:
    """Writes the failed rows (error not null) and returns their count by error."""
    bad = df.filter("error is not null")
    bad.write.mode("append").parquet(folder)
    return bad.groupBy("error").agg(F.count("*").alias("n"))


def save_model(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Model arrays as a table (name, shape, data): overwritten when a better model is found."""
    rows = [(k, list(map(int, v.shape)), v.astype(float).ravel().tolist()) for k, v in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r[0]: np.array(r[2]).reshape(r[1]) for r in spark.read.parquet(path).collect()}


def overlay(rasters: DataFrame, components: DataFrame, labels: DataFrame, under: int) -> DataFrame:
    """image_id, r, c of the pixels of components of fewer than ``under`` pixels: what a noise overlay would draw."""
    from .fixtures import pixels

    small = components.filter(F.col("size") < under).select("image_id", F.col("label").alias("v"))
    return pixels(labels).join(small, ["image_id", "v"], "left_semi").select("image_id", "r", "c")
