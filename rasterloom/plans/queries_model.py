"""Queries of scaling, clustering and anomaly operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import anomaly, cluster
from ..sources import fixtures as fx
from . import pipelines
from .registry import query

S = SparkSession
EPS, MIN_SAMPLES = 9.3, 5

Z = f"{fx.VEC}, ds AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY d), z AS (SELECT id, d, (v - m) / CASE WHEN s > 0 THEN s ELSE 1.0 END AS z FROM x JOIN ds USING (d))"


@query("q_standardize", f"WITH {Z} SELECT id, d, z AS v{{r}} FROM z")
def _(spark: S, sf: str) -> DataFrame:
    return cluster.long_form(cluster.standardize(fx.vectors(spark, sf)))


@query("q_covariance", f"WITH {fx.VEC} SELECT a.d AS i, b.d AS j, covar_pop(a.v, b.v) AS cov{{r}} FROM x a JOIN x b ON b.id = a.id AND a.d <= b.d GROUP BY a.d, b.d")
def _(spark: S, sf: str) -> DataFrame:
    return cluster.covariance(fx.vectors(spark, sf))


@query("q_pca_project")
def _(spark: S, sf: str) -> DataFrame:
    v = cluster.standardize(fx.vectors(spark, sf))
    return cluster.long_form(cluster.Components(v, 2).project(v))


@query("q_pca_explained", f"WITH {fx.VEC} SELECT 64 AS k, CAST(1.0 AS DOUBLE) AS ratio_sum{{r}}, sum(v) AS total_variance{{r}} FROM (SELECT d, var_pop(v) AS v FROM x GROUP BY d) q")
def _(spark: S, sf: str) -> DataFrame:
    """The explained ratios of all components, which must add up to 1, and the variance they share."""
    v = fx.vectors(spark, sf)
    c = cluster.Components(v, 64)
    total = cluster.long_form(v).groupBy("d").agg(F.var_pop("v").alias("v")).agg(F.sum("v").alias("total_variance"))
    return total.select(F.lit(len(c.loadings)).alias("k"), F.lit(float(c.ratio.sum())).alias("ratio_sum"), "total_variance")


DBSCAN = f"""{Z}, zl AS (SELECT id, list(z ORDER BY d) AS z FROM z GROUP BY id),
near AS (SELECT a.id AS a, b.id AS b FROM zl a JOIN zl b ON list_distance(a.z, b.z) <= {EPS}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
cc AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, cc.b FROM reach r JOIN cc ON cc.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a), num AS (SELECT root, dense_rank() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM root) q),
lab AS (SELECT zl.id, CAST(coalesce(min(num.k), -1) AS INTEGER) AS cluster FROM zl LEFT JOIN near ON near.a = zl.id
  LEFT JOIN root ON root.id = near.b AND (zl.id NOT IN (SELECT id FROM core) OR near.b = zl.id) LEFT JOIN num ON num.root = root.root GROUP BY zl.id)"""


def _dbscan(spark: S, sf: str) -> DataFrame:
    return cluster.dbscan(cluster.standardize(fx.vectors(spark, sf)), EPS, MIN_SAMPLES)


@query("q_dbscan", f"WITH RECURSIVE {DBSCAN} SELECT id, cluster FROM lab")
def _(spark: S, sf: str) -> DataFrame:
    return _dbscan(spark, sf)


@query("q_dbscan_summary", f"WITH RECURSIVE {DBSCAN} SELECT count(*) AS n, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) FILTER (WHERE cluster = -1) AS n_noise FROM lab")
def _(spark: S, sf: str) -> DataFrame:
    return cluster.cluster_summary(_dbscan(spark, sf))


@query("q_cluster_partition", f"WITH RECURSIVE {DBSCAN} SELECT 'cluster_' || cluster AS part, count(*) AS n FROM lab GROUP BY 1")
def _(spark: S, sf: str) -> DataFrame:
    return _dbscan(spark, sf).groupBy(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("part")).agg(F.count("*").alias("n"))


@query("q_ward_merges")
def _(spark: S, sf: str) -> DataFrame:
    return cluster.ward_merges(fx.vectors(spark, sf))


@query("q_ward_clusters")
def _(spark: S, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    return cluster.ward_clusters(cluster.standardize(cluster.Components(v, 50).project(v)), 50.76)


@query("q_isolation_forest")
def _(spark: S, sf: str) -> DataFrame:
    v = fx.vectors(spark, sf)
    return anomaly.contamination_cut(anomaly.IsolationForest(v).scores(v), 0.2)


TRAIN = f"{fx.VEC}, sp AS (SELECT vec_id AS id, row_number() OVER (ORDER BY md5(vec_id || '|42'), vec_id) <= floor(0.2 * count(*) OVER ()) AS train FROM embeddings)"
ERRORS = f"{TRAIN}, mi AS (SELECT d, avg(v) AS m FROM x JOIN sp USING (id) WHERE train GROUP BY d), er AS (SELECT id, avg((v - m) * (v - m)) AS error FROM x JOIN mi USING (d) GROUP BY id)"
LABELS = f"{ERRORS}, th AS (SELECT avg(error) + 2 * stddev_pop(error) AS threshold FROM er JOIN sp USING (id) WHERE train), la AS (SELECT id, error, threshold, CASE WHEN error < threshold THEN 'normal' ELSE 'anomalous' END AS label FROM er CROSS JOIN th)"


def _errors(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    """(errors of all vectors, errors of the training split)."""
    v = fx.vectors(spark, sf)
    train = anomaly.split_seeded(v, 0.2).filter("split = 'train'").select("id", "x")
    return anomaly.mean_image_errors(train, v), anomaly.mean_image_errors(train, train)


def _labels(spark: S, sf: str) -> DataFrame:
    every, train = _errors(spark, sf)
    return anomaly.classify(every, anomaly.spread_threshold(train, 2.0))


@query("q_split_seeded", f"WITH {TRAIN} SELECT id, CASE WHEN train THEN 'train' ELSE 'val' END AS split FROM sp")
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.split_seeded(fx.vectors(spark, sf), 0.2).select("id", "split")


@query("q_contamination_cut", f"WITH {ERRORS}, cut AS (SELECT quantile_cont(error, 0.8) AS cut FROM er) SELECT id, error AS error{{r}}, CASE WHEN error > cut THEN -1 ELSE 1 END AS pred FROM er CROSS JOIN cut")
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.contamination_cut(_errors(spark, sf)[0], 0.2, "error")


@query("q_clean_noisy_split", f"WITH {ERRORS}, cut AS (SELECT quantile_cont(error, 0.8) AS cut FROM er) SELECT CASE WHEN error > cut THEN 'noisy' ELSE 'clean' END AS class, count(*) AS n FROM er CROSS JOIN cut GROUP BY 1")
def _(spark: S, sf: str) -> DataFrame:
    cut = anomaly.contamination_cut(_errors(spark, sf)[0], 0.2, "error")
    return cut.groupBy(anomaly.clean_or_noisy(F.col("pred")).alias("class")).agg(F.count("*").alias("n"))


@query("q_recon_threshold", f"WITH {LABELS} SELECT id, error AS error{{r}}, threshold AS threshold{{r}}, label FROM la")
def _(spark: S, sf: str) -> DataFrame:
    return _labels(spark, sf).select("id", "error", "threshold", "label")


@query("q_filter_stats", f"WITH {LABELS} SELECT count(*) AS total, count(*) FILTER (WHERE label = 'normal') AS normal, count(*) FILTER (WHERE label = 'anomalous') AS anomalous FROM la")
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.filter_stats(_labels(spark, sf))


@query("q_class_partition", f"WITH {LABELS} SELECT label AS part, count(*) AS n FROM la GROUP BY label")
def _(spark: S, sf: str) -> DataFrame:
    return _labels(spark, sf).groupBy(F.col("label").alias("part")).agg(F.count("*").alias("n"))


@query("q_recon_histogram", f"WITH {ERRORS}, lim AS (SELECT min(error) AS lo, max(error) AS hi FROM er) SELECT CAST(least(49, floor((error - lo) / (hi - lo) * 50)) AS INTEGER) AS bin, count(*) AS n FROM er CROSS JOIN lim GROUP BY 1")
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.histogram(_errors(spark, sf)[0], 50)


@query("q_pca_autoencoder")
def _(spark: S, sf: str) -> DataFrame:
    return pipelines.autoencoder_labels(fx.vectors(spark, sf), 32, 0.8, 3.0)


@query("q_deep_noise", f"WITH {fx.GRAY}, u AS (SELECT image_id, r, c, (v / 255.0 - 0.5) / 0.5 AS u FROM g), m AS (SELECT r, c, avg(u) AS m FROM u GROUP BY r, c) SELECT image_id AS id, avg((u - m) * (u - m)) AS error{{r}} FROM u JOIN m USING (r, c) GROUP BY image_id")
def _(spark: S, sf: str) -> DataFrame:
    """Reconstruction error of the rasters in [-1, 1] against the mean raster."""
    from ..functions.pixel import signed_range

    g = fx.gray(spark, sf).select(F.col("image_id").alias("id"), F.transform("px", signed_range).alias("x"))
    return anomaly.mean_image_errors(g, g)


LOSS = "ls AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS epoch, loss FROM (SELECT date_trunc('day', ts) AS day, round(avg(value), 6) AS loss FROM events GROUP BY 1) q)"


def _losses(spark: S, sf: str) -> DataFrame:
    e = fx.table(spark, sf, "events")
    d = e.groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return d.select((F.row_number().over(Window.orderBy("day")) - 1).cast("int").alias("epoch"), "loss")


@query(
    "q_early_stop",
    f"""WITH RECURSIVE {LOSS}, st AS (SELECT epoch, loss, loss AS best, 0 AS waited, true AS improved FROM ls WHERE epoch = 0
  UNION ALL SELECT ls.epoch, ls.loss, CASE WHEN ls.loss < st.best - 0.1 THEN ls.loss ELSE st.best END, CASE WHEN ls.loss < st.best - 0.1 THEN 0 ELSE st.waited + 1 END, ls.loss < st.best - 0.1 FROM st JOIN ls ON ls.epoch = st.epoch + 1 WHERE st.waited < 5)
SELECT epoch, loss AS loss{{r}}, best AS best{{r}}, waited, improved FROM st""",
)
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.early_stop(_losses(spark, sf), 5, 0.1)


@query(
    "q_plateau_lr",
    f"""WITH RECURSIVE {LOSS}, st AS (SELECT epoch, loss AS best, 0 AS waited, CAST(0.001 AS DOUBLE) AS lr FROM ls WHERE epoch = 0
  UNION ALL SELECT ls.epoch, least(st.best, ls.loss), CASE WHEN ls.loss < st.best OR st.waited + 1 > 3 THEN 0 ELSE st.waited + 1 END, CASE WHEN ls.loss >= st.best AND st.waited + 1 > 3 THEN st.lr * 0.5 ELSE st.lr END FROM st JOIN ls ON ls.epoch = st.epoch + 1)
SELECT epoch, round(lr * 1000, 9) AS lr{{r}} FROM st""",
)
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.plateau_lr(_losses(spark, sf), 0.001, 0.5, 3).select("epoch", (F.col("lr") * 1000).alias("lr"))


_LAYERS = ", ".join(f"('{k}', {a}, {b}, {c})" for k, a, b, c in anomaly.LAYERS)


@query(
    "q_param_count",
    f"""SELECT kind, CAST(sum(CASE kind WHEN 'conv' THEN kernel * kernel * inputs * outputs + outputs WHEN 'linear' THEN inputs * outputs + outputs ELSE 2 * outputs END) AS BIGINT) AS params FROM (VALUES {_LAYERS}) AS l(kind, inputs, outputs, kernel) GROUP BY kind""",
)
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.param_count(spark.createDataFrame(list(anomaly.LAYERS), "kind string, inputs int, outputs int, kernel int"))


@query("q_forest_features")
def _(spark: S, sf: str) -> DataFrame:
    """Isolation forest over the graph features of yearly trade: score, prediction and class."""
    from ..operators import graph_features as gf

    f = gf.features45(fx.trade_nodes(spark, sf), fx.trade_edges(spark, sf)).withColumnRenamed("graph_id", "id")
    return pipelines.forest_labels(f, gf.FEATURES)
