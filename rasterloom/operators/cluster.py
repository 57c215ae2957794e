"""Feature scaling, principal components, density and hierarchical clustering on (id, x array<double>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_form(df: DataFrame) -> DataFrame:
    """id, d, v."""
    return df.select("id", F.posexplode_outer("x").alias("d", "v")).filter("d is not null")


def dimension_stats(df: DataFrame) -> DataFrame:
    """d, mean, std (population): partial sums per task, one row per dimension exchanged."""
    return long_form(df).groupBy("d").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def standardize(df: DataFrame) -> DataFrame:
    """x as z-scores with the population deviation; a dimension without variance is only centred.

    The statistics are one row per dimension and go back as two literal-sized arrays, so the data are not exchanged.
    """
    s = dimension_stats(df).agg(F.array_sort(F.collect_list(F.struct("d", "mean", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0).alias("std")))).alias("s"))
    z = F.zip_with("x", "s", lambda v, q: (v - q["mean"]) / q["std"])
    return df.crossJoin(F.broadcast(s)).select("id", z.alias("x"))


def covariance(df: DataFrame) -> DataFrame:
    """i, j, cov (population) for i <= j, from sums of products: one pass, d * (d + 1) / 2 rows exchanged per task."""
    p = df.select(F.posexplode("x").alias("i", "a"), "x").select("i", "a", F.posexplode("x").alias("j", "b")).filter("i <= j")
    return p.groupBy("i", "j").agg(F.covar_pop("a", "b").alias("cov"))


def _gram(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of x: one row of sums per task, added up on the driver in a fixed order."""
    width = df.select(F.max(F.size("x"))).first()[0] or 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=float).reshape(-1, width)
            n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], ["n", "total", "square"])

    n, total, square = 0, np.zeros(width), np.zeros((width, width))
    for row in df.select("x").mapInArrow(sums, "n long, total array<double>, square array<double>").toLocalIterator():
        n, total, square = n + row[0], total + np.array(row[1]), square + np.array(row[2]).reshape(width, width)
    mean = total / max(n, 1)
    return n, mean, square / max(n, 1) - np.outer(mean, mean)


class Components:
    """Principal components of a data set: mean, loadings (rows; the largest loading of each is positive), explained ratios."""

    def __init__(self, df: DataFrame, k: int):
        n, self.mean, cov = _gram(df)
        value, vector = np.linalg.eigh(cov)
        by = np.argsort(-value, kind="stable")
        self.loadings = vector[:, by[:k]].T
        big = np.argmax(np.abs(np.round(self.loadings, 9)), axis=1)
        self.loadings *= np.sign(self.loadings[np.arange(len(big)), big])[:, None]
        self.ratio = np.maximum(value[by], 0) / max(value.sum(), 1e-300)

    def project(self, df: DataFrame) -> DataFrame:
        """x replaced by its components (centred first)."""
        mean, loadings = self.mean, self.loadings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(mean))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((x - mean) @ loadings.T).tolist(), type=pa.list_(pa.float64()))], ["id", "x"])

        return df.select("id", "x").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, x array<double>")

    def errors(self, df: DataFrame) -> DataFrame:
        """id, error: mean squared error of the reconstruction from the components."""
        mean, loadings = self.mean, self.loadings

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(-1, len(mean)) - mean
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(((x - (x @ loadings.T) @ loadings) ** 2).mean(1))], ["id", "error"])

        return df.select("id", "x").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, error double")


def near_pairs(df: DataFrame, eps: float, block_rows: int = 1024) -> DataFrame:
    """a, b (both directions, without self pairs) of vectors at most eps apart.

    Vectors are cut into ranges of their projection on the first axis of most variance; two ranges can hold a pair only
    if they are at most eps apart, so distant ranges never meet.  Each pair of ranges is one matrix product.
    """
    n = df.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "a long, b long")
    first = Components(df, 1)
    axis, mean = F.array(*[F.lit(float(v)) for v in first.loadings[0]]), F.array(*[F.lit(float(v)) for v in first.mean])
    p = F.aggregate(F.zip_with(F.zip_with("x", mean, lambda a, m: a - m), axis, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    df = df.select("id", "x", p.alias("p"))
    parts = max(1, -(-n // block_rows))
    cuts = df.approxQuantile("p", [i / parts for i in range(1, parts)], 0.001) if parts > 1 else []
    edges = [-float("inf"), *cuts, float("inf")]
    slack = eps * (1 + 1e-9) + 1e-9
    meets = [(i, j) for i in range(parts) for j in range(i, parts) if j == i or edges[j] - edges[i + 1] <= slack]
    block = F.lit(0)
    for c in cuts:
        block = block + F.when(F.col("p") >= c, 1).otherwise(0)
    spark = df.sparkSession
    m = spark.createDataFrame(meets, "i int, j int")
    rows = df.withColumn("block", block)
    left = rows.join(F.broadcast(m), F.col("block") == F.col("i")).select("i", "j", F.lit(0).alias("side"), "id", "x")
    right = rows.join(F.broadcast(m.filter("i <> j")), F.col("block") == F.col("j")).select("i", "j", F.lit(1).alias("side"), "id", "x")

    def pairs(key: tuple, t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()
        ids = t.column("id").to_numpy()
        x = np.array(t.column("x").to_pylist(), dtype=float)
        a, b = (side == 0), (side == 1) if key[0].as_py() != key[1].as_py() else (side == 0)
        xa, xb = x[a], x[b]
        found_a, found_b = [], []
        for s in range(0, len(xa), 256):
            d = np.zeros((len(xa[s : s + 256]), len(xb)))
            for k in range(x.shape[1] if x.ndim > 1 else 0):
                d += (xa[s : s + 256, k, None] - xb[None, :, k]) ** 2
            i, j = np.nonzero(np.sqrt(d) <= eps)
            found_a.append(ids[a][s + i])
            found_b.append(ids[b][j])
        one, two = np.concatenate(found_a or [np.zeros(0, dtype=np.int64)]), np.concatenate(found_b or [np.zeros(0, dtype=np.int64)])
        ok = one != two
        one, two = one[ok].astype(np.int64), two[ok].astype(np.int64)
        if key[0].as_py() != key[1].as_py():
            one, two = np.concatenate((one, two)), np.concatenate((two, one))
        return pa.table({"a": one, "b": two})

    return left.unionByName(right).groupBy("i", "j").applyInArrow(pairs, "a long, b long")


def components_of(edges: DataFrame) -> DataFrame:
    """node, component (smallest node) of an edge table a, b: alternating large and small stars, lineage cut each round."""
    current = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(60):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def durable(df: DataFrame) -> DataFrame:
    """Lineage cut through the folder in spark.checkpoint.dir; one of this machine only with a local master and none set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or f"/tmp/checkpoints/{sc.applicationId}")
    return df.checkpoint(eager=True)


def dbscan(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """id, cluster: -1 is noise, clusters are numbered by their smallest core id.

    A point is core with min_samples points at most eps away, itself included; cores in reach of each other are one
    cluster; any other point with a core in reach joins the first such cluster.  Nothing depends on the order of rows.
    """
    near = durable(near_pairs(df, eps))
    ids = df.select("id")
    count = near.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    core = ids.join(count, "id", "left").filter(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("id")
    between = near.join(core.select(F.col("id").alias("a")), "a", "left_semi").join(core.select(F.col("id").alias("b")), "b", "left_semi")
    component = components_of(between)
    cores = core.join(component.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", F.col("id")).alias("root"))
    reach = near.join(cores.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near_root"))
    named = ids.join(cores, "id", "left").join(reach, "id", "left").select("id", F.coalesce("root", "near_root").alias("root"))
    roots = cores.select("root").distinct()
    # numbers of clusters: a rank over one row per cluster
    from pyspark.sql import Window

    numbered = roots.withColumn("cluster", (F.row_number().over(Window.orderBy("root")) - 1).cast("int"))
    return named.join(F.broadcast(numbered), "root", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """n, n_clusters (without noise), n_noise."""
    return labelled.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"), F.sum(F.when(F.col("cluster") == -1, 1).otherwise(0)).alias("n_noise"))


def ward_linkage(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Merge table (a, b, height, size) of Ward's method by nearest-neighbour chains; clusters from n on are merges in order of
    height.  Distances between singletons are Euclidean; weight: how many points a row stands for."""
    n = len(x)
    if n < 2:
        return np.zeros((0, 4))
    size = np.ones(n) if weight is None else weight.astype(float).copy()
    centre = x.astype(float).copy()
    alive = np.ones(n, dtype=bool)
    raw: list[tuple[int, int, float]] = []
    chain: list[int] = []
    while len(raw) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        d = ((centre - centre[a]) ** 2).sum(1) * (2 * size * size[a] / (size + size[a]))
        d[~alive] = np.inf
        d[a] = np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b] * (1 + 1e-12):
            b = chain[-2]
            raw.append((a, b, float(np.sqrt(d[b]))))
            keep, gone = min(a, b), max(a, b)
            centre[keep] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
            size[keep] += size[gone]
            alive[gone] = False
            chain = chain[:-2]
        else:
            chain.append(b)
    root, name, count = list(range(n)), list(range(n)), np.ones(n) if weight is None else weight.astype(float).copy()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = np.zeros((n - 1, 4))
    for k, (a, b, h) in enumerate(sorted(raw, key=lambda m: m[2])):
        i, j = find(a), find(b)
        out[k] = min(name[i], name[j]), max(name[i], name[j]), h, count[i] + count[j]
        root[j], name[i] = i, n + k
        count[i] += count[j]
    return out


#: Rows that Ward's method takes as they are; more are first gathered in this many micro-clusters.
WARD_ROWS = 4_000


def _ward_points(df: DataFrame, most: int = WARD_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """Keys, points, weights, and a table id -> key.  Above ``most`` rows the points are k-means micro-clusters."""
    if df.count() <= most:
        rows = sorted(df.select("id", "x").collect(), key=lambda r: r[0])
        return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float), np.ones(len(rows)), df.select("id", F.col("id").alias("key"))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.select("id", "x", array_to_vector("x").alias("features"))
    model = KMeans(k=most // 4, seed=42, maxIter=10).fit(data)
    found = durable(model.transform(data).select("id", F.col("prediction").alias("key")))
    weight = {r[0]: r[1] for r in found.groupBy("key").count().collect()}
    keys = np.array(sorted(weight), dtype=np.int64)
    return keys, np.array([model.clusterCenters()[k] for k in keys]), np.array([weight[k] for k in keys], dtype=float), found


def ward_merges(df: DataFrame) -> DataFrame:
    """step, a, b, height, size: the dendrogram's rows."""
    _, x, weight, _ = _ward_points(df)
    rows = [(k, int(a), int(b), float(h), int(n)) for k, (a, b, h, n) in enumerate(ward_linkage(x, weight).tolist())]
    return df.sparkSession.createDataFrame(rows, "step int, a int, b int, height double, size long")


def flat_cut(table: np.ndarray, n: int, height: float) -> np.ndarray:
    """Cluster of each point when merges up to a height are done: numbered from 1 by smallest member."""
    root = list(range(n + len(table)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, (a, b, h, _) in enumerate(table.tolist()):
        if h <= height:
            root[find(int(a))] = n + k
            root[find(int(b))] = n + k
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(i), len(seen) + 1) for i in range(n)], dtype=np.int64)


def ward_clusters(df: DataFrame, height: float) -> DataFrame:
    """id, cluster."""
    keys, x, weight, member = _ward_points(df)
    label = flat_cut(ward_linkage(x, weight), len(x), height)
    names = df.sparkSession.createDataFrame([(int(k), int(c)) for k, c in zip(keys, label, strict=True)], "key long, cluster int")
    return member.withColumn("key", F.col("key").cast("long")).join(F.broadcast(names), "key").select("id", "cluster")
