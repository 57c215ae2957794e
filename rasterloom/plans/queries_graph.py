"""Queries of the graph features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster
from ..operators import graph_features as gf
from ..sources import fixtures as fx
from . import pipelines
from .registry import query

S = SparkSession


def _trade(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.trade_nodes(spark, sf), fx.trade_edges(spark, sf)


def _months(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.month_nodes(spark, sf), fx.month_edges(spark, sf)


def _moments_sql(source: str, prefix: str) -> str:
    """Moments of column x by graph_id, deviations taken from the mean first."""
    return f"""SELECT graph_id, avg(x) AS {prefix}_mean{{r}}, avg(dx * dx) AS {prefix}_variance{{r}},
  CASE WHEN avg(dx * dx) > 1e-24 THEN avg(dx * dx * dx) / pow(avg(dx * dx), 1.5) END AS {prefix}_skewness{{r}},
  CASE WHEN avg(dx * dx) > 1e-24 THEN avg(dx * dx * dx * dx) / pow(avg(dx * dx), 2) - 3 END AS {prefix}_kurtosis{{r}}
FROM (SELECT graph_id, x, x - avg(x) OVER (PARTITION BY graph_id) AS dx FROM {source}) q GROUP BY graph_id"""


DEG = "both_ways AS (SELECT graph_id, src AS u, dst AS v, length FROM te UNION ALL SELECT graph_id, dst, src, length FROM te), deg AS (SELECT tn.graph_id, tn.node, count(e.v) AS degree FROM tn LEFT JOIN both_ways e ON e.graph_id = tn.graph_id AND e.u = tn.node GROUP BY tn.graph_id, tn.node)"


@query(
    "q_graph_basic",
    f"""WITH {fx.TRADE}, n AS (SELECT graph_id, count(*) AS n_nodes FROM tn GROUP BY graph_id), m AS (SELECT graph_id, count(*) AS n_edges FROM te GROUP BY graph_id)
SELECT graph_id, n_nodes, coalesce(n_edges, 0) AS n_edges, 2.0 * coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1)) AS graph_density{{r}}, n_nodes / 100.0 AS density_intersection{{r}} FROM n LEFT JOIN m USING (graph_id)""",
)
def _(spark: S, sf: str) -> DataFrame:
    return gf.basic(*_trade(spark, sf))


@query("q_length_moments", f"WITH {fx.TRADE} {_moments_sql('(SELECT graph_id, length AS x FROM te) s', 'length')}")
def _(spark: S, sf: str) -> DataFrame:
    return gf.length_moments(fx.trade_edges(spark, sf))


@query("q_degree_moments", f"WITH {fx.TRADE}, {DEG} {_moments_sql('(SELECT graph_id, degree / 4.0 AS x FROM deg) s', 'degree')}")
def _(spark: S, sf: str) -> DataFrame:
    return gf.degree_moments(*_trade(spark, sf))


CLUSTERING = f"""{fx.TRADE}, {DEG}, top AS (SELECT graph_id, max(length) AS top FROM te GROUP BY graph_id),
tri AS (SELECT a.graph_id, a.src AS a, a.dst AS b, b.dst AS c, cbrt((a.length / top) * (b.length / top) * (c.length / top)) AS g
  FROM te a JOIN te b ON b.graph_id = a.graph_id AND b.src = a.dst JOIN te c ON c.graph_id = a.graph_id AND c.src = a.src AND c.dst = b.dst JOIN top ON top.graph_id = a.graph_id),
corner AS (SELECT graph_id, a AS node, g FROM tri UNION ALL SELECT graph_id, b, g FROM tri UNION ALL SELECT graph_id, c, g FROM tri),
loc AS (SELECT d.graph_id, d.node, CASE WHEN d.degree > 1 THEN 2 * coalesce(sum(k.g), 0) / (d.degree * (d.degree - 1)) ELSE 0.0 END AS x
  FROM deg d LEFT JOIN corner k ON k.graph_id = d.graph_id AND k.node = d.node GROUP BY d.graph_id, d.node, d.degree)"""


@query("q_clustering_coeff", f"WITH {CLUSTERING} {_moments_sql('loc', 'local_clustering')}")
def _(spark: S, sf: str) -> DataFrame:
    return gf.clustering_moments(*_trade(spark, sf))


@query(
    "q_triangles_transitivity",
    f"""WITH {CLUSTERING}, w AS (SELECT graph_id, sum(degree * (degree - 1) / 2.0) AS wedges FROM deg GROUP BY graph_id), t AS (SELECT graph_id, count(*) AS k FROM tri GROUP BY graph_id), m AS (SELECT graph_id, avg(x) AS x FROM loc GROUP BY graph_id)
SELECT w.graph_id, coalesce(t.k, 0) AS num_triangles, CASE WHEN wedges > 0 THEN 3.0 * coalesce(t.k, 0) / wedges ELSE 0.0 END AS transitivity{{r}}, m.x AS avg_clustering{{r}} FROM w LEFT JOIN t USING (graph_id) JOIN m USING (graph_id)""",
)
def _(spark: S, sf: str) -> DataFrame:
    return gf.triangles_transitivity(*_trade(spark, sf))


@query(
    "q_assortativity",
    f"""WITH {fx.MTRADE}, e AS (SELECT graph_id, src AS u, dst AS v, CAST(w AS DOUBLE) AS w FROM me UNION ALL SELECT graph_id, dst, src, CAST(w AS DOUBLE) FROM me), s AS (SELECT graph_id, u, sum(w) AS s FROM e GROUP BY graph_id, u)
SELECT e.graph_id, CASE WHEN var_pop(a.s) > 1e-9 THEN corr(a.s, b.s) END AS assortativity{{r}} FROM e JOIN s a ON a.graph_id = e.graph_id AND a.u = e.u JOIN s b ON b.graph_id = e.graph_id AND b.u = e.v GROUP BY e.graph_id""",
)
def _(spark: S, sf: str) -> DataFrame:
    return gf.assortativity(fx.month_edges(spark, sf), "w")


# All simple paths of the small trade graphs: distances, hops and shortest path counts follow.
PATHS = f"""{fx.TRADE}, e AS (SELECT graph_id, src AS u, dst AS v, length FROM te UNION ALL SELECT graph_id, dst, src, length FROM te),
p AS (SELECT graph_id, node AS s, node AS t, CAST(0.0 AS DOUBLE) AS d, [node] AS seen FROM tn
  UNION ALL SELECT p.graph_id, p.s, e.v, p.d + e.length, list_append(p.seen, e.v) FROM p JOIN e ON e.graph_id = p.graph_id AND e.u = p.t WHERE NOT list_contains(p.seen, e.v)),
dist AS (SELECT graph_id, s, t, min(d) AS d, min(len(seen)) - 1 AS hops FROM p WHERE s <> t GROUP BY graph_id, s, t),
sizes AS (SELECT graph_id, count(*) AS n FROM tn GROUP BY graph_id),
whole AS (SELECT sizes.graph_id, count(dist.s) = n * (n - 1) AS fine FROM sizes LEFT JOIN dist ON dist.graph_id = sizes.graph_id GROUP BY sizes.graph_id, n)"""


@query(
    "q_apsp_metrics",
    f"""WITH RECURSIVE {PATHS}, mo AS ({_moments_sql('(SELECT dist.graph_id, d AS x FROM dist JOIN whole ON whole.graph_id = dist.graph_id AND whole.fine) s', 'path_length').replace('{r}', '')}),
ecc AS (SELECT graph_id, s, max(d) AS ecc FROM dist GROUP BY graph_id, s), agg AS (SELECT graph_id, max(ecc) AS diameter, min(ecc) AS radius FROM ecc GROUP BY graph_id), wi AS (SELECT graph_id, sum(d) / 2 AS wiener FROM dist GROUP BY graph_id)
SELECT whole.graph_id, path_length_mean AS path_length_mean{{r}}, path_length_variance AS path_length_variance{{r}}, path_length_skewness AS path_length_skewness{{r}}, path_length_kurtosis AS path_length_kurtosis{{r}},
  CASE WHEN fine THEN diameter END AS diameter{{r}}, CASE WHEN fine THEN radius END AS radius{{r}}, CASE WHEN fine THEN wiener END AS wiener_index{{r}}
FROM whole LEFT JOIN mo USING (graph_id) LEFT JOIN agg USING (graph_id) LEFT JOIN wi USING (graph_id)""",
)
def _(spark: S, sf: str) -> DataFrame:
    return gf.per_graph(*_trade(spark, sf), gf.path_metrics, gf.PATH_COLUMNS)


def _node_moments(prefix: str, fn):
    columns = [f"{prefix}_{m}" for m in gf.MOMENTS]
    return columns, lambda g: dict(zip(columns, gf.array_moments(fn(g)), strict=True))


@query(
    "q_closeness",
    f"""WITH RECURSIVE {PATHS}, c AS (SELECT tn.graph_id, tn.node, count(d.t) AS r, sum(d.d) AS s FROM tn LEFT JOIN dist d ON d.graph_id = tn.graph_id AND d.s = tn.node GROUP BY tn.graph_id, tn.node),
x AS (SELECT graph_id, CASE WHEN r > 0 THEN r / s * r / 4.0 ELSE 0.0 END AS x FROM c) {_moments_sql('x', 'closeness')}""",
)
def _(spark: S, sf: str) -> DataFrame:
    columns, fn = _node_moments("closeness", lambda g: g.closeness(g.distances()))
    return gf.per_graph(*_trade(spark, sf), fn, columns)


@query(
    "q_betweenness",
    f"""WITH RECURSIVE {PATHS}, best AS (SELECT p.* FROM p JOIN dist ON dist.graph_id = p.graph_id AND dist.s = p.s AND dist.t = p.t AND p.d <= dist.d * (1 + 1e-12)),
total AS (SELECT graph_id, s, t, count(*) AS k FROM best GROUP BY graph_id, s, t),
inner_nodes AS (SELECT graph_id, s, t, unnest(seen) AS v FROM best), through AS (SELECT graph_id, s, t, v, count(*) AS k FROM inner_nodes WHERE v <> s AND v <> t GROUP BY graph_id, s, t, v),
b AS (SELECT tn.graph_id, tn.node, coalesce(sum(CAST(through.k AS DOUBLE) / total.k), 0) / 12.0 AS x FROM tn LEFT JOIN through ON through.graph_id = tn.graph_id AND through.v = tn.node LEFT JOIN total ON total.graph_id = through.graph_id AND total.s = through.s AND total.t = through.t GROUP BY tn.graph_id, tn.node)
{_moments_sql('b', 'betweenness')}""",
)
def _(spark: S, sf: str) -> DataFrame:
    columns, fn = _node_moments("betweenness", lambda g: g.betweenness())
    return gf.per_graph(*_trade(spark, sf), fn, columns)


@query("q_efficiency", f"WITH RECURSIVE {PATHS} SELECT sizes.graph_id, coalesce(sum(1.0 / hops), 0) / any_value(n * (n - 1)) AS efficiency{{r}} FROM sizes LEFT JOIN dist ON dist.graph_id = sizes.graph_id GROUP BY sizes.graph_id")
def _(spark: S, sf: str) -> DataFrame:
    return gf.per_graph(*_trade(spark, sf), lambda g: {"efficiency": g.efficiency()}, ["efficiency"])


@query(
    "q_graph_components",
    f"""WITH RECURSIVE {fx.MTRADE}, e AS (SELECT graph_id, src AS u, dst AS v FROM me UNION ALL SELECT graph_id, dst, src FROM me),
reach(graph_id, a, b) AS (SELECT graph_id, node, node FROM mn UNION SELECT r.graph_id, r.a, e.v FROM reach r JOIN e ON e.graph_id = r.graph_id AND e.u = r.b),
root AS (SELECT graph_id, a, min(b) AS root FROM reach GROUP BY graph_id, a)
SELECT graph_id, count(DISTINCT root) AS n_components, count(DISTINCT root) = 1 AS connected FROM root GROUP BY graph_id""",
)
def _(spark: S, sf: str) -> DataFrame:
    nodes, edges = _months(spark, sf)
    key = lambda x: F.col("graph_id").cast("long") * 1000 + F.col(x)
    c = cluster.components_of(edges.select(key("src").alias("a"), key("dst").alias("b")))
    named = nodes.withColumn("node", key("node")).join(c, "node", "left").withColumn("root", F.coalesce("component", F.col("node")))
    return named.groupBy("graph_id").agg(F.countDistinct("root").alias("n_components")).withColumn("connected", F.col("n_components") == 1)


@query(
    "q_modularity_given_partition",
    f"""WITH {fx.MTRADE}, e AS (SELECT graph_id, w, a.n_regionkey AS ca, b.n_regionkey AS cb FROM me JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst),
m AS (SELECT graph_id, sum(w) AS m FROM e GROUP BY graph_id), s AS (SELECT graph_id, c, sum(w) AS s, sum(i) AS i FROM (SELECT graph_id, ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM e UNION ALL SELECT graph_id, cb, w, 0 FROM e) q GROUP BY graph_id, c)
SELECT s.graph_id, sum(i / CAST(m AS DOUBLE) - pow(s / (2.0 * m), 2)) AS modularity{{r}} FROM s JOIN m USING (graph_id) GROUP BY s.graph_id""",
)
def _(spark: S, sf: str) -> DataFrame:
    n = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))
    return gf.modularity(fx.month_edges(spark, sf), n, "w")


@query("q_modularity_greedy")
def _(spark: S, sf: str) -> DataFrame:
    return gf.per_graph(*_months(spark, sf), lambda g: {"modularity": g.modularity(), "communities": float(len(set(g.communities())))}, ["modularity", "communities"], "w")


@query("q_spectral")
def _(spark: S, sf: str) -> DataFrame:
    return gf.per_graph(*_trade(spark, sf), lambda g: {"algebraic_connectivity": g.algebraic_connectivity(), "spectral_radius": g.spectral_radius()}, gf.SPECTRAL_COLUMNS)


@query("q_eigenvector")
def _(spark: S, sf: str) -> DataFrame:
    columns, fn = _node_moments("eigenvector", lambda g: g.eigenvector())
    return gf.per_graph(*_trade(spark, sf), fn, columns)


@query("q_node_connectivity")
def _(spark: S, sf: str) -> DataFrame:
    return gf.per_graph(*_trade(spark, sf), lambda g: {"avg_node_connectivity": g.average_connectivity()}, ["avg_node_connectivity"])


@query("q_features45")
def _(spark: S, sf: str) -> DataFrame:
    return gf.features45(*_trade(spark, sf))


@query("q_feature_row")
def _(spark: S, sf: str) -> DataFrame:
    """Contour score, edge score and the 45 graph features of each raster."""
    from ..operators import kernels

    skeletons = kernels.thin(fx.blobs(spark, sf))
    nodes, edges = pipelines.skeleton_graphs(skeletons)
    return pipelines.feature_rows(fx.gray(spark, sf), nodes, edges, 2.0, 1024.0)
