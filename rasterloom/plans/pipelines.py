"""Compositions of the operators into the batch pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixel
from ..operators import anomaly, cluster, graph, graph_features, kernels, points, regions, stencil


def noise_level(rasters: DataFrame, block: int = 15, c: float = 5.0) -> DataFrame:
    """image_id, noise: mean of the inverse adaptive threshold."""
    t = stencil.adaptive_threshold(rasters, block, c)
    return t.select("image_id", (F.aggregate("px", F.lit(0.0), lambda a, x: a + x) / F.size("px")).alias("noise"))


def preprocess(rasters: DataFrame, strength: float = 10.0, template: int = 3, search: int = 5, blur: int = 3, clip: float = 2.0, grid: tuple[int, int] = (2, 2), block: int = 15, c: float = 5.0, close: tuple[int, int] = (2, 2), most: int = 1000) -> DataFrame:
    """Gray rasters to cleaned binary ones: highlights, denoise, blur, equalise, threshold, close, small components."""
    df = rasters.withColumn("px", F.transform("px", lambda v: pixel.replace_highlights(v)))
    df = kernels.denoise_nlm(df, strength, template, search)
    df = stencil.gaussian_blur(df, blur)
    df = df.withColumn("px", F.transform("px", lambda v: F.round(v).cast("int")))
    df = kernels.clahe(df, clip, grid)
    df = stencil.morph_close(stencil.adaptive_threshold(df, block, c), close)
    return regions.small_component_mask(df, most)


def skeletons(rasters: DataFrame, open_kernel: tuple[int, int] = (2, 2), close_kernel: tuple[int, int] = (3, 3), hole: int = 300, pad: int = 10, **kw) -> DataFrame:
    """Gray rasters to skeletons: preprocess, remove noise, fill holes, turn upright, thin."""
    df = regions.fill_small_holes(stencil.remove_noise(preprocess(rasters, **kw), open_kernel, close_kernel), hole)
    angle = regions.orientation(df)
    df = df.join(angle, "image_id", "left")
    df = stencil.rotate_nearest(df, -(F.coalesce("angle", F.lit(90.0)) - 90), pad)
    return kernels.thin(df)


def crop_full(skeleton: DataFrame, paths: DataFrame, pads: tuple[int, int, int, int] = (15, 15, 25, 15), col_guard: int = 2, row_guard: int = 20, nearer_than: float = 5.0, edge: int = 20, jump: int = 5) -> DataFrame:
    """Skeletons cut by the rules of their path (image_id, path), then to the padded bounds of their junctions.

    The upper border, where there is one, stands for the topmost junction; the leftmost pixel stands for the leftmost
    junction where that is right of the path's fallback.  A raster without junctions, or narrower than its cut, gets null px.
    """
    j = skeleton.join(paths, "image_id")
    cut = F.greatest(F.lit(0), F.col("w") - regions.crop_columns(F.col("path"), F.col("w")))
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: F.slice("px", (y * F.col("w") + 1).cast("int"), F.col("nw"))))
    df = j.withColumn("nw", cut.cast("int")).withColumn("cut", F.when(F.col("nw") > 0, rows)).select("image_id", "path", "h", F.col("nw").alias("w"), F.col("cut").alias("px"))
    found = points.find_junctions(df.drop("path"), nearer_than)
    fallback = regions.left_fallback(F.col("path"), F.col("w"))
    instead = df.select("image_id", regions.raster_border(edge, jump).alias("border"), fallback.alias("fallback"), regions.raster_leftmost().alias("first"))
    left = F.array_min(F.transform("points", lambda p: p["c"]))
    found = found.join(instead, "image_id").withColumn("leftmost", F.when((F.col("fallback") > 0) & (left > F.col("fallback")), F.col("first")))
    return regions.crop(df.drop("path"), regions.junction_box(found, pads, col_guard, row_guard))


def skeleton_graphs(skeleton: DataFrame, nearer_than: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graphs of skeletons."""
    j = points.find_junctions(skeleton, nearer_than)
    nodes = points.listed(j).select(F.col("image_id").alias("graph_id"), F.col("ord").alias("node"))
    return nodes, graph.trace_graphs(skeleton, j)


def feature_rows(rasters: DataFrame, nodes: DataFrame, edges: DataFrame, under: float = 50.0, area: float = 100.0) -> DataFrame:
    """image_id, contour_score, edge_score and the 45 graph features (null where a raster has no graph)."""
    c = kernels.contours(rasters.withColumn("px", F.transform("px", lambda v: pixel.threshold(v)))).groupBy("image_id").agg(F.sum(F.when(F.col("area") < under, 1).otherwise(0)).cast("double").alias("contour_score"))
    e = stencil.sobel_std(rasters).withColumnRenamed("edge_std", "edge_score")
    f = graph_features.features45(nodes, edges, area).withColumnRenamed("graph_id", "image_id")
    out = rasters.select("image_id").join(c, "image_id", "left").join(e, "image_id").join(f, "image_id", "left")
    return out.withColumn("contour_score", F.coalesce("contour_score", F.lit(0.0)))


def forest_labels(features: DataFrame, columns: list[str], contamination: float = 0.2, seed: int = 42) -> DataFrame:
    """id, score, pred, class: isolation forest over imputed features."""
    x = anomaly.impute(features, columns)
    scored = anomaly.IsolationForest(x, seed=seed).scores(x)
    return anomaly.contamination_cut(scored, contamination).withColumn("class", anomaly.clean_or_noisy(F.col("pred")))


def autoencoder_labels(vectors: DataFrame, latent: int = 32, share: float = 0.2, k: float = 3.0, seed: int = 42) -> DataFrame:
    """id, error, threshold, label: linear autoencoder (principal components) fitted on the training split, threshold from the
    training errors, every vector labelled."""
    train = anomaly.split_seeded(vectors, share, seed).filter("split = 'train'").select("id", "x")
    model = cluster.Components(train, latent)
    return anomaly.classify(model.errors(vectors), anomaly.spread_threshold(model.errors(train), k))


def morphology_profile(rasters: DataFrame, cut: int = 127, nearer_than: float = 5.0) -> DataFrame:
    """image_id, on_pixels, n_components, n_junctions, angle, edge_std of gray rasters."""
    b = rasters.withColumn("px", F.transform("px", lambda v: pixel.threshold(v, cut, 255, 0)))
    on = b.select("image_id", F.size(F.filter("px", lambda v: v > 0)).alias("on_pixels"))
    comps = kernels.components(b).select("image_id", F.size(F.array_distinct(F.filter("px", lambda v: v > 0))).alias("n_components"))
    j = points.find_junctions(b, nearer_than).select("image_id", F.size("points").alias("n_junctions"))
    return on.join(comps, "image_id").join(j, "image_id").join(regions.orientation(b), "image_id", "left").join(stencil.sobel_std(rasters, cut), "image_id")
