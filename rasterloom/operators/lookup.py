"""Joins that pick parameters, skip finished work and route failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import base_name


def nearest_params(probes: DataFrame, params: DataFrame, last_row_only: bool = False) -> DataFrame:
    """probe_id, ord, delta: the parameter row of the probe's folder whose noise is nearest to its level (ties: the first by
    ord); probes without a folder are left out.  last_row_only: only the last row of a folder is known.

    A folder's rows are gathered once in a sorted list, so a probe is one row in and one out and never meets them all as
    rows.
    """
    per = params.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("ord", "noise"))).alias("rows"))
    if last_row_only:
        per = per.withColumn("rows", F.slice("rows", -1, 1))
    near = F.array_min(F.transform("rows", lambda p: F.struct(F.abs(p["noise"] - F.col("level")).alias("delta"), p["ord"].alias("ord"))))
    return probes.join(per, "folder").select("probe_id", near["ord"].alias("ord"), near["delta"].alias("delta"))


def unprocessed(images: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Images whose base name is not among the finished ones, whatever the folders."""
    names = done.select(base_name(F.col(path)).alias("_name")).distinct()
    return images.withColumn("_name", base_name(F.col(path))).join(names, "_name", "left_anti").drop("_name")


def with_status(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds error: the name of the first failed check (its column true), null if all hold; nothing is dropped."""
    error = F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in checks])
    return df.withColumn("error", error)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without, rows with an error)."""
    return df.filter("error is null").drop("error"), df.filter("error is not null")
