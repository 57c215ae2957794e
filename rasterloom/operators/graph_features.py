"""Features of undirected weighted graphs: node (graph_id, node) and edge (graph_id, src, dst, length) relations.

Counts, moments, clustering, assortativity and modularity are relational.  Path and
spectral features need the whole graph at once: the edges of a graph are gathered in
one row and worked on with numpy, one graph at a time.  Undefined values are null.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("mean", "variance", "skewness", "kurtosis")


def moments(x: str, prefix: str) -> list[Column]:
    """Mean, population variance, skewness and excess kurtosis; the last two are null without variance."""
    spread = F.var_pop(x) > 1e-24
    return [
        F.avg(x).alias(f"{prefix}_mean"),
        F.var_pop(x).alias(f"{prefix}_variance"),
        F.when(spread, F.skewness(x)).alias(f"{prefix}_skewness"),
        F.when(spread, F.kurtosis(x)).alias(f"{prefix}_kurtosis"),
    ]


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: graph_id, u, v and the edge's other columns."""
    rest = [c for c in edges.columns if c not in ("graph_id", "src", "dst")]
    ends = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return edges.select("graph_id", ends.alias("e"), *rest).select("graph_id", "e.u", "e.v", *rest)


def basic(nodes: DataFrame, edges: DataFrame, area: float = 100.0) -> DataFrame:
    """graph_id, nodes, edges, density 2m / (n (n - 1)), nodes per area."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"))
    m = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"))
    g = n.join(m, "graph_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    density = F.when(F.col("n_nodes") > 1, 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0)
    return g.withColumn("graph_density", density).withColumn("density_intersection", F.lit(0.0) if area <= 0 else F.col("n_nodes") / F.lit(float(area)))


def length_moments(edges: DataFrame) -> DataFrame:
    return edges.groupBy("graph_id").agg(*moments("length", "length"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, degree (isolated nodes: 0)."""
    d = both_ways(edges.select("graph_id", "src", "dst")).groupBy("graph_id", F.col("u").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(d, ["graph_id", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree_moments(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))
    d = degrees(nodes, edges).join(n, "graph_id").withColumn("x", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)))
    return d.groupBy("graph_id").agg(*moments("x", "degree"))


def triangles(edges: DataFrame, weight: str) -> DataFrame:
    """graph_id, a < b < c and the three weights of every triangle: wedges of the smaller ends closed by an equi-join."""
    e = edges.select("graph_id", "src", "dst", F.col(weight).alias("w"))
    one = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1"))
    two = e.select("graph_id", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("w").alias("w2"))
    three = e.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("c"), F.col("w").alias("w3"))
    return one.join(two, ["graph_id", "b"]).join(three, ["graph_id", "a", "c"])


def local_clustering(nodes: DataFrame, edges: DataFrame, weight: str = "length") -> DataFrame:
    """graph_id, node, clustering: sum over triangles of the cube root of the scaled weights' product, times 2 / (deg (deg - 1))."""
    top = edges.groupBy("graph_id").agg(F.max(weight).alias("top"))
    t = triangles(edges, weight).join(top, "graph_id")
    t = t.withColumn("g", F.cbrt((F.col("w1") / F.col("top")) * (F.col("w2") / F.col("top")) * (F.col("w3") / F.col("top"))))
    per = t.select("graph_id", "g", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("graph_id", "node").agg(F.sum("g").alias("g"))
    d = degrees(nodes, edges).join(per, ["graph_id", "node"], "left")
    return d.select("graph_id", "node", F.when(F.col("degree") > 1, 2 * F.coalesce("g", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def clustering_moments(nodes: DataFrame, edges: DataFrame, weight: str = "length") -> DataFrame:
    return local_clustering(nodes, edges, weight).groupBy("graph_id").agg(*moments("clustering", "local_clustering"))


def triangles_transitivity(nodes: DataFrame, edges: DataFrame, weight: str = "length") -> DataFrame:
    """graph_id, triangles, transitivity (3 triangles / wedges, 0 without wedges), mean local clustering."""
    t = triangles(edges, weight).groupBy("graph_id").agg(F.count("*").alias("num_triangles"))
    wedges = degrees(nodes, edges).groupBy("graph_id").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("wedges"))
    mean = local_clustering(nodes, edges, weight).groupBy("graph_id").agg(F.avg("clustering").alias("avg_clustering"))
    out = wedges.join(t, "graph_id", "left").join(mean, "graph_id").withColumn("num_triangles", F.coalesce("num_triangles", F.lit(0)))
    return out.select("graph_id", "num_triangles", F.when(F.col("wedges") > 0, 3.0 * F.col("num_triangles") / F.col("wedges")).otherwise(0.0).alias("transitivity"), "avg_clustering")


def assortativity(edges: DataFrame, weight: str) -> DataFrame:
    """graph_id, assortativity: correlation of the ends' weighted degrees over both directions; null without variance."""
    e = both_ways(edges.select("graph_id", "src", "dst", F.col(weight).cast("double").alias("w")))
    s = e.groupBy("graph_id", F.col("u").alias("node")).agg(F.sum("w").alias("s"))
    j = e.join(s.select("graph_id", F.col("node").alias("u"), F.col("s").alias("su")), ["graph_id", "u"]).join(s.select("graph_id", F.col("node").alias("v"), F.col("s").alias("sv")), ["graph_id", "v"])
    return j.groupBy("graph_id").agg(F.when(F.var_pop("su") > 1e-9, F.try_divide(F.covar_pop("su", "sv"), F.stddev_pop("su") * F.stddev_pop("sv"))).alias("assortativity"))


def modularity(edges: DataFrame, partition: DataFrame, weight: str) -> DataFrame:
    """graph_id, modularity of a partition (node, community): sum over communities of inside / m - (strength / 2 m)^2."""
    p = lambda name: partition.select(F.col("node").alias(name), F.col("community").alias(f"{name}_c"))
    e = edges.select("graph_id", "src", "dst", F.col(weight).cast("double").alias("w")).join(F.broadcast(p("src")), "src").join(F.broadcast(p("dst")), "dst")
    total = e.groupBy("graph_id").agg(F.sum("w").alias("m"))
    inside = e.filter("src_c = dst_c").groupBy("graph_id", F.col("src_c").alias("c")).agg(F.sum("w").alias("inside"))
    ends = e.select("graph_id", "w", F.explode(F.array("src_c", "dst_c")).alias("c")).groupBy("graph_id", "c").agg(F.sum("w").alias("strength"))
    j = ends.join(inside, ["graph_id", "c"], "left").join(total, "graph_id")
    term = F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("strength") / (2 * F.col("m")), 2)
    return j.groupBy("graph_id").agg(F.sum(term).alias("modularity"))


class Graph:
    """One graph in arrays, nodes numbered from 0 in their order."""

    def __init__(self, nodes: list[int], edges: list[tuple[int, int, float]]):
        self.nodes = sorted(nodes)
        number = {x: i for i, x in enumerate(self.nodes)}
        self.n = len(self.nodes)
        self.edges = sorted((min(number[a], number[b]), max(number[a], number[b]), float(w)) for a, b, w in edges)
        self.weight = np.zeros((self.n, self.n))
        for a, b, w in self.edges:
            self.weight[a, b] = self.weight[b, a] = w
        self.around: list[list[tuple[int, float]]] = [[] for _ in range(self.n)]
        for a, b, w in self.edges:
            self.around[a].append((b, w))
            self.around[b].append((a, w))

    def shortest(self, source: int) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[int]]:
        """Distances, numbers of shortest paths, predecessors and settling order from one node."""
        dist, count = np.full(self.n, np.inf), np.zeros(self.n)
        before: list[list[int]] = [[] for _ in range(self.n)]
        dist[source], count[source] = 0.0, 1.0
        heap, settled, order = [(0.0, source)], set(), []
        while heap:
            d, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled.add(u)
            order.append(u)
            for v, w in self.around[u]:
                new = d + w
                if new < dist[v] - 1e-12 * max(1.0, new):
                    dist[v], count[v], before[v] = new, count[u], [u]
                    heapq.heappush(heap, (new, v))
                elif v not in settled and abs(new - dist[v]) <= 1e-12 * max(1.0, new):
                    count[v] += count[u]
                    before[v].append(u)
        return dist, count, before, order

    def hops(self, source: int) -> np.ndarray:
        out = np.full(self.n, np.inf)
        out[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, _ in self.around[u]:
                if out[v] == np.inf:
                    out[v] = out[u] + 1
                    queue.append(v)
        return out

    def distances(self) -> np.ndarray:
        return np.array([self.shortest(s)[0] for s in range(self.n)]).reshape(self.n, self.n)

    def betweenness(self) -> np.ndarray:
        """Weighted, over ordered pairs, divided by (n - 1)(n - 2)."""
        total = np.zeros(self.n)
        for s in range(self.n):
            _, count, before, order = self.shortest(s)
            share = np.zeros(self.n)
            for v in reversed(order):
                for u in before[v]:
                    share[u] += count[u] / count[v] * (1 + share[v])
                if v != s:
                    total[v] += share[v]
        return total / ((self.n - 1) * (self.n - 2)) if self.n > 2 else total

    def closeness(self, dist: np.ndarray) -> np.ndarray:
        """(reachable / sum of distances) * (reachable / (n - 1)); 0 for isolated nodes."""
        out = np.zeros(self.n)
        for s in range(self.n):
            d = dist[s][np.isfinite(dist[s])]
            if d.sum() > 0 and self.n > 1:
                out[s] = (len(d) - 1) / d.sum() * (len(d) - 1) / (self.n - 1)
        return out

    def eigenvector(self, rounds: int = 1000, near: float = 1e-6) -> np.ndarray | None:
        """Power iteration of the weights plus the identity; None without convergence."""
        if not self.n:
            return None
        x = np.full(self.n, 1 / self.n)
        for _ in range(rounds):
            new = x + self.weight @ x
            new = new / (np.linalg.norm(new) or 1.0)
            if np.abs(new - x).sum() < self.n * near:
                return new
            x = new
        return None

    def components(self) -> int:
        left, n = set(range(self.n)), 0
        while left:
            n += 1
            seen = np.flatnonzero(np.isfinite(self.hops(min(left))))
            left -= set(seen.tolist())
        return n

    def efficiency(self) -> float:
        if self.n < 2:
            return 0.0
        h = np.array([self.hops(s) for s in range(self.n)])
        far = h[~np.eye(self.n, dtype=bool)]
        return float((1 / far).sum() / (self.n * (self.n - 1)))

    def communities(self) -> list[int]:
        """Greedy agglomeration: the pair of linked communities whose union raises modularity most (ties: the smaller pair),
        until none does."""
        m = self.weight.sum() / 2
        of = list(range(self.n))
        if m == 0:
            return of
        inside, strength = self.weight.copy(), self.weight.sum(axis=1)
        alive = set(range(self.n))
        while True:
            best = None
            for a in sorted(alive):
                for b in sorted(alive):
                    if a < b and inside[a, b] > 0:
                        gain = inside[a, b] / m - strength[a] * strength[b] / (2 * m * m)
                        if best is None or gain > best[0] + 1e-12:
                            best = gain, a, b
            if best is None or best[0] <= 1e-12:
                return of
            _, a, b = best
            inside[a] += inside[b]
            inside[:, a] += inside[:, b]
            strength[a] += strength[b]
            alive.discard(b)
            of = [a if c == b else c for c in of]

    def modularity(self) -> float | None:
        m = self.weight.sum() / 2
        if m == 0:
            return None
        of = np.array(self.communities())
        strength = self.weight.sum(axis=1)
        return float(sum(self.weight[np.ix_(of == c, of == c)].sum() / (2 * m) - (strength[of == c].sum() / (2 * m)) ** 2 for c in set(of.tolist())))

    def algebraic_connectivity(self) -> float | None:
        if self.n < 2:
            return None
        laplacian = np.diag(self.weight.sum(axis=1)) - self.weight
        return float(max(0.0, np.linalg.eigvalsh(laplacian)[1]))

    def spectral_radius(self) -> float | None:
        return float(np.abs(np.linalg.eigvalsh(self.weight)).max()) if self.n else None

    def average_connectivity(self) -> float:
        """Mean over pairs of the number of paths that share no inner node."""
        if self.n < 2:
            return 0.0
        total = sum(self._disjoint_paths(s, t) for s in range(self.n) for t in range(s + 1, self.n))
        return total / (self.n * (self.n - 1) / 2)

    def _disjoint_paths(self, s: int, t: int) -> int:
        # node x is split in 2x (in) and 2x + 1 (out); unit capacities, augmenting paths
        cap: dict[tuple[int, int], int] = {}
        for x in range(self.n):
            cap[2 * x, 2 * x + 1] = self.n if x in (s, t) else 1
        for a, b, _ in self.edges:
            cap[2 * a + 1, 2 * b] = cap[2 * b + 1, 2 * a] = 1
        out: list[set[int]] = [set() for _ in range(2 * self.n)]
        for a, b in cap:
            out[a].add(b)
            out[b].add(a)
        flow = 0
        while True:
            parent, queue = {2 * s: None}, deque([2 * s])
            while queue and 2 * t + 1 not in parent:
                u = queue.popleft()
                for v in out[u]:
                    if v not in parent and cap.get((u, v), 0) > 0:
                        parent[v] = u
                        queue.append(v)
            if 2 * t + 1 not in parent:
                return flow
            v = 2 * t + 1
            while (u := parent[v]) is not None:
                cap[u, v] -= 1
                cap[v, u] = cap.get((v, u), 0) + 1
                v = u
            flow += 1


def array_moments(x: np.ndarray | None) -> list[float | None]:
    """Mean, population variance, skewness, excess kurtosis; null where undefined."""
    if x is None or not len(x):
        return [None] * 4
    mean, var = float(np.mean(x)), float(np.var(x))
    if var <= 1e-24:
        return [mean, var, None, None]
    z = (x - mean) / math.sqrt(var)
    return [mean, var, float(np.mean(z**3)), float(np.mean(z**4) - 3)]


def per_graph(nodes: DataFrame, edges: DataFrame, fn: Callable[[Graph], dict[str, float | None]], columns: list[str], weight: str = "length") -> DataFrame:
    """graph_id and the named doubles that fn gives for each graph; the nodes and edges of a graph are one row."""
    n = nodes.groupBy("graph_id").agg(F.collect_list(F.col("node").cast("long")).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col(weight).cast("double").alias("w"))).alias("edges"))
    g = n.join(e, "graph_id", "left").select(F.col("graph_id").cast("long"), "nodes", "edges")

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for ns, es in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rows.append(fn(Graph(ns, [(x["src"], x["dst"], x["w"]) for x in es or ()])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), *(pa.array([r[c] for r in rows], type=pa.float64()) for c in columns)], ["graph_id", *columns])

    return g.mapInArrow(run, "graph_id long, " + ", ".join(f"{c} double" for c in columns))


def _named(prefix: str, x: np.ndarray | None) -> dict[str, float | None]:
    return {f"{prefix}_{m}": v for m, v in zip(MOMENTS, array_moments(x), strict=True)}


def path_metrics(g: Graph) -> dict[str, float | None]:
    """Path length moments over ordered pairs, diameter, radius, Wiener index: null unless connected with two nodes at least."""
    dist = g.distances()
    fine = g.n > 1 and bool(np.isfinite(dist).all())
    far = dist[~np.eye(g.n, dtype=bool)] if fine else None
    out = _named("path_length", far)
    ecc = dist.max(axis=1) if fine else None
    return out | {"diameter": float(ecc.max()) if fine else None, "radius": float(ecc.min()) if fine else None, "wiener_index": float(far.sum() / 2) if fine else None}


PATH_COLUMNS = [f"path_length_{m}" for m in MOMENTS] + ["diameter", "radius", "wiener_index"]
SPECTRAL_COLUMNS = ["algebraic_connectivity", "spectral_radius"]

FEATURES = (
    ["density_intersection"]
    + [f"{p}_{m}" for p in ("length", "degree", "betweenness", "closeness", "eigenvector", "local_clustering", "path_length") for m in MOMENTS]
    + ["global_node_count", "global_edge_count", "global_graph_density", "global_diameter", "global_radius", "global_wiener_index", "global_assortativity", "global_transitivity", "global_avg_clustering", "global_efficiency", "global_num_connected_components", "global_algebraic_connectivity", "global_modularity", "global_num_triangles", "global_avg_node_connectivity", "global_spectral_radius"]
)


def all_features(g: Graph, area: float = 100.0) -> dict[str, float | None]:
    """The 45 features of one graph, each distance computed once."""
    deg = np.array([len(x) for x in g.around], dtype=float)
    top = g.weight.max() if g.edges else 1.0
    cube = np.cbrt(g.weight / top)
    per_node = np.diag(cube @ cube @ cube) / 2
    local = np.array([2 * t / (d * (d - 1)) if d > 1 else 0.0 for t, d in zip(per_node, deg, strict=True)])
    hit = (g.weight > 0).astype(float)
    n_triangles = float(np.trace(hit @ hit @ hit) / 6)
    wedges = float((deg * (deg - 1) / 2).sum())
    strength = g.weight.sum(axis=1)
    ends = np.array([(strength[a], strength[b]) for u, v, _ in g.edges for a, b in ((u, v), (v, u))]).reshape(-1, 2)
    paths = path_metrics(g)
    return (
        {"density_intersection": g.n / area if area > 0 else 0.0}
        | _named("length", np.array([w for _, _, w in g.edges]))
        | _named("degree", deg / (g.n - 1) if g.n > 1 else None)
        | _named("betweenness", g.betweenness())
        | _named("closeness", g.closeness(g.distances()))
        | _named("eigenvector", g.eigenvector())
        | _named("local_clustering", local)
        | {k: v for k, v in paths.items() if k.startswith("path_length")}
        | {
            "global_node_count": float(g.n),
            "global_edge_count": float(len(g.edges)),
            "global_graph_density": 2.0 * len(g.edges) / (g.n * (g.n - 1)) if g.n > 1 else 0.0,
            "global_diameter": paths["diameter"],
            "global_radius": paths["radius"],
            "global_wiener_index": paths["wiener_index"],
            "global_assortativity": float(np.corrcoef(ends.T)[0, 1]) if len(ends) and ends[:, 0].var() > 1e-9 else None,
            "global_transitivity": 3 * n_triangles / wedges if wedges else 0.0,
            "global_avg_clustering": float(local.mean()) if g.n else None,
            "global_efficiency": g.efficiency(),
            "global_num_connected_components": float(g.components()),
            "global_algebraic_connectivity": g.algebraic_connectivity(),
            "global_modularity": g.modularity(),
            "global_num_triangles": n_triangles,
            "global_avg_node_connectivity": g.average_connectivity(),
            "global_spectral_radius": g.spectral_radius(),
        }
    )


def features45(nodes: DataFrame, edges: DataFrame, area: float = 100.0, weight: str = "length") -> DataFrame:
    return per_graph(nodes, edges, lambda g: all_features(g, area), FEATURES, weight)
