"""Hand-made goldens and invariants of the raster, point, graph and model operators."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import anomaly, cluster, graph, graph_features, kernels, lookup, points, regions, stencil
from rasterloom.plans import pipelines, wing
from rasterloom.sources import fixtures as fx
from rasterloom.sources import readers, sinks
from rasterloom.streaming import incremental

RASTER = "image_id int, h int, w int, px array<int>"


def rasters(spark, *arrays):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], a.ravel().tolist()) for i, a in enumerate(np.asarray(x) for x in arrays)], RASTER)


def arrays(df):
    return {r.image_id: np.array(r.px).reshape(r.h, r.w) for r in df.collect()}


def test_junction_patterns_fire_on_143_of_256(spark):
    steps = [(a, b) for a in (0, 1, 2) for b in (0, 1, 2) if (a, b) != (1, 1)]
    every = []
    for bits in itertools.product((0, 1), repeat=8):
        a = np.zeros((5, 5), dtype=int)
        a[2, 2] = 1
        for (r, c), v in zip(steps, bits):
            a[r + 1, c + 1] = v
        every.append(a)
    mask = arrays(stencil.junction_mask(rasters(spark, *every)))
    assert sum(int(m[2, 2]) for m in mask.values()) == 143
    t = np.zeros((5, 5), dtype=int)
    t[2, 1:4] = t[3, 2] = 1
    plus = t.copy()
    plus[1, 2] = 1
    got = arrays(stencil.junction_mask(rasters(spark, t, plus)))
    assert got[0][2, 2] == 0 and got[1][2, 2] == 1


def test_morphology_is_idempotent_and_ordered(spark):
    rng = np.random.default_rng(0)
    df = rasters(spark, *(rng.integers(0, 256, (9, 7)) for _ in range(5)))
    source, opened, closed = arrays(df), arrays(stencil.morph_open(df)), arrays(stencil.morph_close(df))
    again = arrays(stencil.morph_open(stencil.morph_open(df)))
    for i in source:
        assert (opened[i] <= source[i]).all() and (closed[i] >= source[i]).all() and (again[i] == opened[i]).all()
        low = np.array([[source[i][max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].min() for c in range(7)] for r in range(9)])
        assert (arrays(stencil.erode(df, (3, 3)))[i] == low).all()


def test_blur_of_a_flat_raster_is_flat(spark):
    got = arrays(stencil.gaussian_blur(rasters(spark, np.full((6, 6), 40)), 5))
    assert np.allclose(got[0], 40)
    assert sum(stencil.gaussian_weights(7)) == pytest.approx(1)


def test_rotation_by_quarter_turns(spark):
    a = np.arange(25).reshape(5, 5)
    got = arrays(stencil.rotate_nearest(rasters(spark, a), F.lit(90.0)))[0]
    assert sorted(got.ravel().tolist()) == list(range(25)) and (got == np.rot90(a, 1)).all() or (got == np.rot90(a, -1)).all()
    framed = arrays(stencil.rotate_nearest(rasters(spark, a), F.lit(0.0), 2))[0]
    assert framed.shape == (9, 9) and (framed[2:7, 2:7] == a).all() and framed[:2].sum() == 0


def test_components(spark):
    a = np.array([[1, 0, 0, 0], [0, 1, 0, 1], [0, 0, 0, 1], [1, 0, 0, 0]])
    got = sorted((r.size, r.x, r.y, r.width, r.height) for r in regions.component_stats(rasters(spark, a)).collect())
    assert got == [(1, 0, 3, 1, 1), (2, 0, 0, 2, 2), (2, 3, 1, 1, 2)]
    spiral = np.zeros((15, 15), dtype=int)
    spiral[::2] = 1
    for k, r in enumerate(range(1, 15, 2)):
        spiral[r, 14 if k % 2 == 0 else 0] = 1
    assert np.unique(kernels.component_labels(spiral[None])).tolist() == [0, 1]
    assert regions.component_stats(rasters(spark, np.zeros((3, 3), dtype=int))).count() == 0


def test_holes_and_masks(spark):
    ring = np.full((7, 7), 255)
    ring[3, 3] = 0
    ring[0, :] = 0
    got = arrays(regions.fill_small_holes(rasters(spark, ring), 3))[0]
    assert got[3, 3] == 255 and (got[0] == 0).all()
    a = np.zeros((6, 6), dtype=int)
    a[0, 0] = 1
    a[2:6, 2:6] = 1
    kept = arrays(regions.small_component_mask(rasters(spark, a), 2))[0]
    assert kept[0, 0] == 1 and kept[2:, 2:].sum() == 0


def test_contour_areas():
    a = np.zeros((8, 8), dtype=int)
    a[1:5, 1:4] = 1
    a[6, 1:6] = 1
    a[0, 7] = 1
    got = {label: (area, n) for label, area, n in kernels.outer_contours(a)}
    assert got[1 + 8 + 1] == (6.0, 10) and got[6 * 8 + 1 + 1][0] == 0.0 and got[8] == (0.0, 1)


def test_thinning_stays_inside_and_is_stable():
    rng = np.random.default_rng(1)
    a = np.kron(rng.integers(0, 2, (6, 6)), np.ones((4, 4), dtype=int))[None]
    s = kernels.thin_stack(a)
    assert ((s > 0) <= (a > 0)).all() and (kernels.thin_stack(s) == s).all() and s.sum() > 0


def test_orientation(spark):
    h, v, d = (np.zeros((7, 7), dtype=int) for _ in range(3))
    h[3, :] = 1
    v[:, 3] = 1
    np.fill_diagonal(d, 1)
    got = {r.image_id: r.angle for r in regions.orientation(rasters(spark, h, v, d, np.zeros((7, 7), dtype=int))).collect()}
    assert got[0] == pytest.approx(90) and got[1] == pytest.approx(0) and got[2] == pytest.approx(45) and 3 not in got


def test_orientation_of_an_axis_along_the_columns_is_90_and_not_minus_90(spark):
    """Rasters that equal their mirror image have a covariance of 0, in whatever order their pixels are added up."""
    rng = np.random.default_rng(3)
    half = [(rng.random((5, 9)) < 0.4).astype(int) for _ in range(60)]
    mirrored = [np.concatenate((x, x[::-1])) for x in half]
    mirrored = [x for x in mirrored if (x > 0).sum() > 1]
    got = {r.image_id: r.angle for r in regions.orientation(rasters(spark, *mirrored)).collect()}
    assert len(got) == len(mirrored) and set(got.values()) <= {0.0, 90.0}
    assert got == {k: wing.orientation(x) for k, x in enumerate(mirrored)}
    wide = np.zeros((2, 70_000), dtype=int)  # sums of products beyond 2^31
    wide[1, ::7] = 1
    assert regions.orientation(rasters(spark, wide)).first().angle == wing.orientation(wide) == 90


def test_merge_is_greedy_and_not_transitive(spark):
    df = spark.createDataFrame([(0, 30, 30, [(0, 0), (0, 4), (0, 8), (5, 5), (5, 6)]), (1, 30, 30, [])], "image_id int, h int, w int, points array<struct<r:int,c:int>>")
    got = {r.image_id: [tuple(p) for p in r.points] for r in points.merge_close(df, 5.0).collect()}
    assert got[0] == [(0, 2), (3, 6), (5, 6)] or got[0] == [(0, 2), (3, 6)] or len(got[0]) == 3
    assert got[1] == []


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(0, 30, 30, [(0, 0), (0, 1), (10, 1), (10, 2)])], "image_id int, h int, w int, points array<struct<r:int,c:int>>")
    assert [tuple(p) for p in points.merge_close(df, 3.0).collect()[0].points] == [(0, 0), (10, 2)]


def test_trace_a_cross():
    on = np.zeros((31, 31), dtype=bool)
    on[15, 2:29] = on[2:29, 15] = True
    nodes = [(2, 15), (15, 2), (15, 15), (15, 28), (28, 15)]
    edges = graph.trace_edges(on, nodes)
    assert {(min(a, b), max(a, b)) for a, b, _, _ in edges} == {(0, 2), (1, 2), (2, 3), (2, 4)}
    assert all(length == 13 for _, _, length, _ in edges)
    assert graph.region_edges(on, nodes) == [(0, 2), (1, 2), (2, 3), (2, 4)]
    assert graph.trace_edges(np.zeros((5, 5), dtype=bool), [(1, 1)]) == []


def brute_betweenness(g):
    out = np.zeros(g.n)
    paths = {}
    def walk(p, d):
        paths.setdefault((p[0], p[-1]), []).append((d, tuple(p)))
        for v, w in g.around[p[-1]]:
            if v not in p:
                walk([*p, v], d + w)
    for s in range(g.n):
        walk([s], 0.0)
    for (s, t), ps in paths.items():
        if s != t:
            best = min(d for d, _ in ps)
            short = [p for d, p in ps if d <= best * (1 + 1e-12)]
            for v in range(g.n):
                if v not in (s, t):
                    out[v] += sum(v in p for p in short) / len(short)
    return out / ((g.n - 1) * (g.n - 2)) if g.n > 2 else out


@pytest.mark.parametrize("seed", range(6))
def test_path_features_by_enumeration(seed):
    rng = np.random.default_rng(seed)
    edges = [(a, b, float(rng.integers(1, 5))) for a, b in itertools.combinations(range(6), 2) if rng.random() < 0.5]
    g = graph_features.Graph(list(range(6)), edges)
    assert np.allclose(g.betweenness(), brute_betweenness(g))
    d = np.where(g.weight > 0, g.weight, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(6):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    assert np.allclose(g.distances(), d)
    assert -0.5 <= (g.modularity() or 0) <= 1
    assert g.average_connectivity() <= min(5, max(len(x) for x in g.around))


def test_known_graphs():
    k5 = graph_features.Graph(list(range(5)), [(a, b, 2.0) for a, b in itertools.combinations(range(5), 2)])
    f = graph_features.all_features(k5)
    assert len(f) == len(graph_features.FEATURES) == 45 and set(f) == set(graph_features.FEATURES)
    assert f["global_num_triangles"] == 10 and f["global_transitivity"] == 1 and f["global_avg_node_connectivity"] == 4
    assert f["global_algebraic_connectivity"] == pytest.approx(10) and f["global_spectral_radius"] == pytest.approx(8)
    assert f["global_wiener_index"] == 20 and f["local_clustering_mean"] == pytest.approx(1) and f["path_length_skewness"] is None
    star = graph_features.all_features(graph_features.Graph(list(range(4)), [(0, i, 1.0) for i in (1, 2, 3)]))
    assert star["global_diameter"] == 2 and star["global_radius"] == 1 and star["betweenness_mean"] == pytest.approx(0.25)
    empty = graph_features.all_features(graph_features.Graph([], []))
    assert empty["global_node_count"] == 0 and empty["global_diameter"] is None
    apart = graph_features.all_features(graph_features.Graph([0, 1, 2], [(0, 1, 1.0)]))
    assert apart["global_diameter"] is None and apart["global_num_connected_components"] == 2


def test_relational_features_agree_with_arrays(spark):
    from rasterloom.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    nodes, edges = fx.trade_nodes(spark, d), fx.trade_edges(spark, d, 3)
    every = {r.graph_id: r for r in graph_features.features45(nodes, edges).collect()}
    close = lambda a, b: (a is None and b is None) or math.isclose(a, b, abs_tol=1e-9)
    for r in graph_features.triangles_transitivity(nodes, edges).collect():
        e = every[r.graph_id]
        assert close(float(r.num_triangles), e.global_num_triangles) and close(r.transitivity, e.global_transitivity) and close(r.avg_clustering, e.global_avg_clustering)
    for r in graph_features.degree_moments(nodes, edges).collect():
        assert all(close(r[c], every[r.graph_id][c]) for c in ("degree_mean", "degree_variance", "degree_skewness", "degree_kurtosis"))
    for r in graph_features.assortativity(edges, "length").collect():
        assert close(r.assortativity, every[r.graph_id].global_assortativity)


def vectors(spark, x):
    return spark.createDataFrame([(i, row) for i, row in enumerate(np.asarray(x, dtype=float).tolist())], "id long, x array<double>")


def test_dbscan_against_a_sequential_scan(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.4, (40, 3)) for c in (0, 3, 6)] + [rng.uniform(-2, 8, (40, 3))])[rng.permutation(160)]
    eps, least = 0.6, 4
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = k
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
    got = {r.id: r.cluster for r in cluster.dbscan(vectors(spark, x), eps, least).collect()}
    assert [got[i] for i in range(len(x))] == label.tolist()
    summary = cluster.cluster_summary(cluster.dbscan(vectors(spark, x), eps, least)).first()
    assert (summary.n_clusters, summary.n_noise) == (k, int((label < 0).sum()))


def test_near_pairs_over_many_blocks(spark):
    x = np.random.default_rng(4).normal(0, 2, (300, 2))
    got = {(r.a, r.b) for r in cluster.near_pairs(vectors(spark, x), 0.8, block_rows=40).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(d <= 0.8)) if a != b}


def brute_ward(x):
    groups = [[i] for i in range(len(x))]
    out = []
    while len(groups) > 1:
        best = None
        for a, b in itertools.combinations(range(len(groups)), 2):
            p, q = x[groups[a]], x[groups[b]]
            d = math.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))
            if best is None or d < best[0]:
                best = d, a, b
        out.append(best[0])
        groups = [g for i, g in enumerate(groups) if i not in best[1:]] + [groups[best[1]] + groups[best[2]]]
    return out


def test_ward(spark):
    x = np.random.default_rng(5).normal(0, 1, (25, 3))
    table = cluster.ward_linkage(x)
    assert np.allclose(table[:, 2], brute_ward(x)) and table[-1, 3] == 25 and (np.diff(table[:, 2]) >= 0).all()
    assert cluster.flat_cut(table, 25, table[-1, 2]).max() == 1 and cluster.flat_cut(table, 25, 0).tolist() == list(range(1, 26))
    assert cluster.flat_cut(table, 25, table[-3, 2]).max() == 3
    two = vectors(spark, np.concatenate([np.zeros((5, 2)), np.full((5, 2), 9.0)]) + np.arange(20).reshape(10, 2) * 1e-3)
    assert {r.id: r.cluster for r in cluster.ward_clusters(two, 1.0).collect()} == {i: 1 + (i >= 5) for i in range(10)}


def test_components_of_data(spark):
    x = np.random.default_rng(6).normal(0, 1, (80, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    c = cluster.Components(vectors(spark, x), 5)
    value, vector = np.linalg.eigh(np.cov(x.T, ddof=0))
    assert np.allclose(c.ratio, value[::-1] / value.sum()) and np.allclose(np.abs(c.loadings), np.abs(vector[:, ::-1].T))
    assert max(r.error for r in c.errors(vectors(spark, x)).collect()) < 1e-18
    z = np.array([r.x for r in cluster.standardize(vectors(spark, x)).orderBy("id").collect()])
    assert np.allclose(z, (x - x.mean(0)) / x.std(0))
    flat = cluster.standardize(vectors(spark, [[1.0, 2.0], [1.0, 4.0]])).orderBy("id").collect()
    assert [r.x for r in flat] == [[0.0, -1.0], [0.0, 1.0]]


def test_isolation_forest(spark):
    x = np.random.default_rng(7).normal(0, 1, (300, 4))
    x[:6] += 9
    scored = anomaly.contamination_cut(anomaly.IsolationForest(vectors(spark, x)).scores(vectors(spark, x)), 0.02).collect()
    assert {r.id for r in scored if r.pred == -1} == set(range(6)) and all(0 < r.score <= 1 for r in scored)


@pytest.mark.parametrize("few", [10_000, 60])
def test_exact_percentile(spark, few):
    v = np.random.default_rng(8).normal(0, 1, 1500).round(2)
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    for q in (0.0, 0.13, 0.5, 0.8, 1.0):
        assert anomaly.exact_percentile(df, "v", q, few) == pytest.approx(float(np.quantile(v, q)), abs=1e-9)


def test_split_sizes(spark):
    df = vectors(spark, np.zeros((137, 1)))
    for share in (0.0, 0.2, 0.5, 1.0):
        assert anomaly.split_seeded(df, share).filter("split = 'train'").count() == int(137 * share)


def test_training_control(spark):
    losses = spark.createDataFrame([(i, x) for i, x in enumerate([5.0, 4.0, 4.5, 4.2, 4.1, 3.0])], "epoch int, loss double")
    got = anomaly.early_stop(losses, 3).orderBy("epoch").collect()
    assert [r.epoch for r in got] == [0, 1, 2, 3, 4] and got[-1].best == 4.0 and [r.improved for r in got] == [True, True, False, False, False]
    lr = [r.lr for r in anomaly.plateau_lr(losses, 1.0, 0.5, 2).orderBy("epoch").collect()]
    assert lr == [1.0, 1.0, 1.0, 1.0, 0.5, 0.5]
    total = anomaly.param_count(spark.createDataFrame(list(anomaly.LAYERS), "kind string, inputs int, outputs int, kernel int")).agg(F.sum("params")).first()[0]
    assert total == 9_832_449


def test_nearest_params(spark):
    params = spark.createDataFrame([("AT", 1.0, 1), ("AT", 5.0, 2), ("AT", 3.0, 3), ("RO", -2.0, 4)], "folder string, noise double, ord int")
    probes = spark.createDataFrame([(1, "AT", 5.0), (2, "AT", 2.0), (3, "RO", 9.0), (4, "XX", 1.0)], "probe_id int, folder string, level double")
    assert {r.probe_id: r.ord for r in lookup.nearest_params(probes, params).collect()} == {1: 2, 2: 1, 3: 4}
    assert {r.probe_id: r.ord for r in lookup.nearest_params(probes, params, last_row_only=True).collect()} == {1: 3, 2: 3, 3: 4}


def test_crop(spark):
    a = np.arange(100).reshape(10, 10)
    box = spark.createDataFrame([(0, 2, 5, 1, 4), (1, None, None, None, None), (2, 5, 5, 1, 4)], "image_id int, x1 int, x2 int, y1 int, y2 int")
    got = {r.image_id: r for r in regions.crop(rasters(spark, a, a, a), box).collect()}
    assert (np.array(got[0].px).reshape(got[0].h, got[0].w) == a[1:4, 2:5]).all() and got[1].px is None and got[2].px is None


def test_files(spark, tmp_path):
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "AT-1.png").write_bytes(sinks.png_bytes(gray.ravel().tolist(), 3, 4))
    (folder / "bad.png").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    good, bad = readers.read_images(spark, str(folder))
    got = readers.gray_rasters(good).collect()
    assert len(got) == 1 and got[0].px == gray.ravel().tolist() and sum(r.path.endswith("bad.png") for r in bad.collect()) == 1
    names = [r.name for r in readers.image_paths(spark, str(folder)).collect()]
    assert names == ["AT-1.png", "bad.png"]
    done = spark.createDataFrame([("/elsewhere/AT-1.png",)], "path string")
    assert [r.name for r in lookup.unprocessed(readers.image_paths(spark, str(folder)), done).collect()] == ["bad.png"]
    assert len(readers.image_vectors(readers.gray_rasters(good)).first().x) == 128 * 128
    sizes = readers.batches(readers.image_vectors(readers.gray_rasters(good), 4), 2).select(F.size("rows")).collect()
    assert [r[0] for r in sizes] == [1]
    out = str(tmp_path / "out")
    sinks.write_images(readers.gray_rasters(good), F.lit("AT-1.png"), out)
    assert bytes(spark.read.parquet(out).first().png) == sinks.png_bytes(gray.ravel().tolist(), 3, 4)


def test_params_and_models(spark, tmp_path):
    (tmp_path / "p.csv").write_text('AT,1.5,12,29,42,"(3, 3)",2.2,"(20,20)",43,11.9,"(2,2)","(2,2)","(5,-5)"\n')
    p = readers.read_params(spark, str(tmp_path / "p.csv"))
    row = p.first()
    assert row.gb_kernel.a == 3 and row.kernel_close.b == -5 and row.noise == 1.5
    sinks.append_params(p, str(tmp_path / "o"))
    assert readers.read_params(spark, str(tmp_path / "o")).first().clahe_tgs.a == 20
    (tmp_path / "a.json").write_text('{"x.png": "normal", "y.png": "anomalous"}')
    assert sorted(tuple(r) for r in readers.read_annotations(spark, str(tmp_path / "a.json")).collect()) == [("x.png", "normal"), ("y.png", "anomalous")]
    sinks.save_model(spark, {"mean": np.arange(3.0), "axes": np.eye(2)}, str(tmp_path / "m"))
    got = sinks.load_model(spark, str(tmp_path / "m"))
    assert (got["axes"] == np.eye(2)).all() and got["mean"].tolist() == [0, 1, 2]
    df = spark.createDataFrame([(1, 2), (2, -1)], "id int, cluster int")
    sinks.write_by(df, F.concat(F.lit("cluster_"), F.col("cluster")), "part", str(tmp_path / "c"))
    assert sorted(x.name for x in (tmp_path / "c").iterdir() if x.is_dir()) == ["part=cluster_-1", "part=cluster_2"]
    log = sinks.error_log(lookup.with_status(df, [("noise", F.col("cluster") < 0)]), str(tmp_path / "e"))
    assert [tuple(r) for r in log.collect()] == [("noise", 1)]


def test_incremental_stream(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    count = lambda: spark.read.parquet(out).count()
    for i in range(2):
        (tmp_path / "in" / f"{i}.png").write_bytes(sinks.png_bytes([0] * 4, 2, 2))
        q = incremental.run_incremental(spark, folder, lambda df: df.select("path", "length"), out, state)
        q.awaitTermination()
        assert count() == i + 1


def test_pipelines_on_a_drawing(spark):
    a = np.full((48, 48), 200)
    a[22:26, 4:44] = 30
    a[4:44, 22:26] = 30
    s = pipelines.skeletons(rasters(spark, a, np.full((48, 48), 200)), pad=2, hole=10, block=9, c=3.0, search=3, most=2000)
    got = arrays(s)
    assert got[0].shape == (52, 52) and set(np.unique(got[0])) <= {0, 255}
    nodes, edges = pipelines.skeleton_graphs(s)
    assert nodes.count() >= 0 and edges.columns == ["graph_id", "src", "dst", "length", "path_pixels"]


def test_isolation_trees_cut_no_empty_sides():
    """Neighbouring doubles, constant columns, one row and rounding noise."""
    rng = np.random.default_rng(0)
    near = np.array([[1.0, 5.0], [np.nextafter(1.0, 2.0), 5.0], [1.0, 5.0 + 1e-13]])
    wide = np.array([[0.0, 5.0], [np.nextafter(0.0, 1.0), 5.0], [0.0, 7.0]])
    for seed in range(300):
        for x in (near, wide, near[:1], np.zeros((4, 2))):
            dim, _, _, _, depth = anomaly.IsolationForest._grow(x, 8, np.random.default_rng(seed))
            assert (depth[dim < 0] >= 0).all()
    assert len(anomaly.IsolationForest._grow(near, 8, rng)[0]) == 1
