"""Point sets of rasters: image_id, h, w, points array<struct<r, c>> in row-major order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pixel import distance
from . import stencil


def merge_close(points: DataFrame, nearer_than: float = 5.0) -> DataFrame:
    """Greedy merge in order: the first point takes all later points nearer than the limit to it (not to each other), and
    their centroid, rounded half to even, is given; then the next point that is left."""
    kind = "array<struct<r:int,c:int>>"
    empty = F.array().cast(kind)

    def step(state: Column, _: Column) -> Column:
        left, done = state["left"], state["done"]
        base = F.get(left, F.lit(0))
        near = lambda p: distance(p["r"], p["c"], base["r"], base["c"]) < nearer_than
        taken = F.filter(left, near)
        mean = lambda name: F.bround(F.aggregate(taken, F.lit(0.0), lambda a, p: a + p[name]) / F.size(taken), 0).cast("int").alias(name)
        more = F.struct(F.filter(left, lambda p: ~near(p)).alias("left"), F.concat(done, F.array(F.struct(mean("r"), mean("c")))).alias("done"))
        return F.when(F.size(left) > 0, more).otherwise(state)

    start = F.struct(F.col("points").cast(kind).alias("left"), empty.alias("done"))
    return points.withColumn("points", F.aggregate("points", start, step, lambda s: s["done"]))


def off_frame(points: DataFrame) -> DataFrame:
    """Without points on the first and last row and column."""
    return points.withColumn("points", F.filter("points", lambda p: (p["r"] != 0) & (p["c"] != 0) & (p["r"] != F.col("h") - 1) & (p["c"] != F.col("w") - 1)))


def find_junctions(df: DataFrame, nearer_than: float = 5.0) -> DataFrame:
    """Junction points of binary rasters: pattern hits in row-major order, merged, without the frame."""
    return off_frame(merge_close(stencil.on_points(stencil.junction_mask(df)), nearer_than))


def listed(points: DataFrame) -> DataFrame:
    """image_id, ord, r, c."""
    return points.select("image_id", F.posexplode_outer("points").alias("ord", "p")).filter("ord is not null").select("image_id", "ord", "p.r", "p.c")


def nearest_node(pixels: DataFrame, nodes: DataFrame, nearer_than: float) -> DataFrame:
    """image_id, r, c, node: the first node (by ord) nearer than the limit to each pixel.

    Grid join: nodes are filed in square buckets as wide as the limit and every pixel looks into the nine around it, so
    no pair farther than two buckets apart is formed.
    """
    size = F.lit(float(nearer_than))
    b = lambda x: F.floor(F.col(x) / size)
    n = nodes.select("image_id", F.col("r").alias("nr"), F.col("c").alias("nc"), "ord").withColumn("br", b("nr")).withColumn("bc", b("nc"))
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    p = pixels.select("image_id", "r", "c", b("r").alias("r0"), b("c").alias("c0"), F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    p = p.select("image_id", "r", "c", (F.col("r0") + F.col("dr")).alias("br"), (F.col("c0") + F.col("dc")).alias("bc"))
    hit = p.join(n, ["image_id", "br", "bc"]).filter(distance(F.col("r"), F.col("c"), F.col("nr"), F.col("nc")) < nearer_than)
    return hit.groupBy("image_id", "r", "c").agg(F.min("ord").alias("node"))


def pattern_match(points: DataFrame, pairs: DataFrame, within: float = 10.0, ratio: float = 0.8) -> DataFrame:
    """a, b, matched, total, similar: points of image a with a point of image b at most ``within`` away."""
    one = points.select(F.col("image_id").alias("a"), F.col("points").alias("pa"))
    two = points.select(F.col("image_id").alias("b"), F.col("points").alias("pb"))
    j = pairs.join(one, "a").join(two, "b")
    hit = F.filter("pa", lambda p: F.exists("pb", lambda q: distance(p["r"], p["c"], q["r"], q["c"]) <= within))
    j = j.select("a", "b", F.size(hit).alias("matched"), F.size("pa").alias("total"))
    return j.withColumn("similar", (F.col("total") > 0) & (F.col("matched") >= ratio * F.col("total")))
