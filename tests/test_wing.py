"""The main job against the single operators, its failures, files and calibration."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import kernels, points, regions, stencil
from rasterloom.plans import pipelines, wing
from rasterloom.sources import readers

ARGS = {"nlm_h": 12, "nlm_tws": 3, "nlm_sws": 5, "gb_kernel": (3, 5), "clahe_cl": 2.2, "clahe_tgs": (2, 3), "thresh_bs": 5, "thresh_c": 3.0, "morphx_kernel": (2, 3), "kernel_open": (1, 2), "kernel_close": (3, 2)}


@pytest.fixture(scope="module")
def grays():
    rng = np.random.default_rng(3)
    out = []
    for k in range(4):
        x = 200 - 150 * (rng.random((26, 34)) < 0.12)
        x[5:24, 6 + 5 * k] = 30
        x[12, 3:31] = 30
        for i in range(9):
            x[3 + i, 20 + i] = x[20 - i, 20 + i] = 30
        x[0, :3] = 250
        out.append(x)
    return out


def _df(spark, rasters):
    return spark.createDataFrame([(k, *x.shape, np.asarray(x).astype(int).ravel().tolist()) for k, x in enumerate(rasters)], "image_id long, h int, w int, px array<int>")


def _rows(df):
    return {r.image_id: (r.h, r.w, [round(float(v), 6) for v in r.px] if r.px is not None else None) for r in df.collect()}


def _same(df, rasters):
    assert _rows(df) == {k: (*x.shape, np.round(np.asarray(x, dtype=float), 6).ravel().tolist()) for k, x in enumerate(rasters)}


def test_steps_are_the_operators(spark, grays):
    df = _df(spark, grays)
    _same(stencil.gaussian_blur(df, 5), [wing.blur(x.astype(float), (5, 5), "reflect") for x in grays])
    cut = [np.where(x <= np.round(wing.blur(x.astype(float), (5, 5), "edge") - 3.0, 6), 255, 0) for x in grays]
    _same(stencil.adaptive_threshold(df, 5, 3.0), cut)
    binary = _df(spark, cut)
    _same(stencil.morph_close(binary, (2, 3)), [wing.close(x, (2, 3)) for x in cut])
    _same(stencil.morph_open(binary, (3, 2)), [wing.opened(x, (3, 2)) for x in cut])
    angles = {r.image_id: r.angle for r in regions.orientation(binary).collect()}
    assert angles == pytest.approx({k: wing.orientation(x) for k, x in enumerate(cut)})
    thin = [kernels.thin_stack(x[None])[0] for x in cut]
    found = {r.image_id: [(p.r, p.c) for p in r.points] for r in points.find_junctions(_df(spark, thin)).collect()}
    assert found == {k: wing.junctions(x) for k, x in enumerate(thin)} and any(found.values())


def test_rotation():
    x = np.zeros((9, 11))
    x[2, 3:8] = 255
    assert (wing.rotate(x, 0.0, 0) == x).all() and wing.rotate(x, 0.0, 2).shape == (13, 15)
    turned = wing.rotate(np.pad(x, 4), 90.0, 0)
    assert turned.sum() == x.sum() and len(np.unique(np.nonzero(turned)[1])) == 1
    ramp = np.tile(np.arange(0, 110, 10.0), (9, 1))
    inside = wing.rotate(ramp, 10.0, 0)[3:6, 4:8]
    expected = np.cos(np.radians(10)) * 10 * (np.arange(4, 8) - 5)[None] - np.sin(np.radians(10)) * 10 * (np.arange(3, 6) - 4)[:, None] + 50
    assert np.abs(inside - expected).max() <= 1.0  # near a plane: with a = -0.75 up to 0.05 of the slope away, and rounded


@pytest.mark.parametrize("path, width", [("/in/XX-1.png", 60), ("/in/PL-1.png", 700), ("/in/PL-2.png", 900), ("/in/HU-2019-1.png", 160), ("/in/MD-1.png", 90)])
def test_full_crop(spark, path, width):
    """The numpy crop is the relational one, with upper border and leftmost pixel."""
    rng = np.random.default_rng(width)
    shapes = []
    for k in range(4):
        x = np.zeros((44, width), dtype=int)
        left = 5 if k % 2 else int(width * 0.3)
        for i in range(9):
            x[18 + i, left + i] = x[26 - i, left + i] = 255
        x[22, left : width - 4 if width < 100 else width // 2] = 255
        if k > 1:
            x[6, 20:32] = x[13, 22:34] = 255  # rows that start after an empty one
        x[30, rng.integers(0, 4)] = 255
        shapes.append(x)
    df = _df(spark, shapes)
    got = _rows(pipelines.crop_full(df, df.select("image_id", F.lit(path).alias("path"))))
    for k, x in enumerate(shapes):
        try:
            y = wing.crop(x, path)
            assert got[k] == (*y.shape, y.astype(float).ravel().tolist())
        except ValueError:
            assert got[k][2] is None


def _blobs(args, path, limits, n):
    """The first n images of random blocks that have a skeleton to crop."""
    out, seed = [], 0
    while len(out) < n:
        on = np.random.default_rng(seed).random((8, 8)) < 0.4
        x, seed = 235 - 200 * np.kron(on, np.ones((4, 4), dtype=int)), seed + 1
        try:
            list(wing.stages(x.astype(float), args, path, **limits))
            out.append(x)
        except ValueError:
            continue
    return out


def test_job(spark, tmp_path):
    """Nearest parameters per image, failures with their context, files under base names, finished images left out."""
    limits = {"most": 1000, "hole": 20, "pad": 2, "crop": {"pads": (1, 1, 1, 1), "row_guard": 1, "edge": 2, "jump": 1}}
    grays = _blobs(ARGS, "/in/XA-1.png", limits, 1) + _blobs(ARGS | {"thresh_c": 2.0}, "/in/XB-2.png", limits, 3)
    pair = "struct<a:int,b:int>"
    as_row = lambda folder, noise, k, **kw: (folder, noise, k, *[v if not isinstance(v, tuple) else {"a": v[0], "b": v[1]} for v in (ARGS | kw).values()])
    kinds = {int: "int", float: "double", tuple: pair}
    params = spark.createDataFrame([as_row("XA", 0.0, 0), as_row("XA", 2550.0, 1, thresh_bs=4), as_row("XB", 10.0, 2, thresh_c=2.0)], "folder string, noise double, ord long, " + ", ".join(f"{k} {kinds[type(v)]}" for k, v in ARGS.items()))
    paths = ["/in/XA-1.png", "/in/XB-2.png", "/in/ZZ-3.png", "/in/XB-4.png"]
    images = _df(spark, grays).withColumn("path", F.element_at(F.array(*[F.lit(p) for p in paths]), (F.col("image_id") + 1).cast("int")))
    broken = spark.createDataFrame([(9, None, None, None, "/in/XA-9.png")], images.schema)
    done = spark.createDataFrame([("/out/XB-4.png",)], "path string")
    every = images.unionByName(broken)
    good, bad = wing.filter_images(every, params, done, block=5, **limits)
    failed = {r.path: r for r in bad.collect()}
    assert "no parameters" in failed["/in/ZZ-3.png"].error and "loaded" in failed["/in/XA-9.png"].error and failed["/in/ZZ-3.png"].folder == "ZZ" and failed["/in/ZZ-3.png"].noise is not None
    levels = {r.image_id: r.noise for r in pipelines.noise_level(images, 5).collect()}
    rows = {r.path: r for r in good.collect()}
    assert "/in/XB-4.png" not in rows and "/in/XB-4.png" not in failed
    for k, args in ((0, ARGS), (1, ARGS | {"thresh_c": 2.0})):
        try:
            *_, (_, expected) = wing.stages(grays[k].astype(float), args, paths[k], **limits)
            assert (rows[paths[k]].h, rows[paths[k]].w, list(rows[paths[k]].px)) == (*expected.shape, expected.astype(int).ravel().tolist())
            assert rows[paths[k]].noise == pytest.approx(levels[k])
        except ValueError as failure:
            assert str(failure) in failed[paths[k]].error and json.loads(failed[paths[k]].args)["nlm_h"] == 12
    assert {"/in/XA-1.png", "/in/XB-2.png"} == set(rows)
    counts = wing.write_job(every, params, done, f"{tmp_path}/out", f"{tmp_path}/log", block=5, **limits)
    assert counts == {"written": len(rows), "failed": len(failed)}
    read, bad_files = readers.read_images(spark, f"{tmp_path}/out")
    assert {r.name for r in read.collect()} == {p.rsplit("/", 1)[1] for p in rows} and bad_files.count() == 0


def test_calibration(spark, tmp_path):
    fields = {"image_path": "/in/XA-1.png", "folder_name": "XA", "nlm_h": " 12", "nlm_tws": "3", "nlm_sws": "5", "gb_kernel": "(3, 5)", "clahe_cl": "2.2", "clahe_tgs": "( 2,3)", "thresh_bs": "5", "thresh_c": "3.0", "morphx_kernel": "(2,3)", "kernel_open": "(1,2)", "kernel_close": "(3, 2)", "debug_args": "gray, thresh", "output_destination": str(tmp_path)}
    limits = {"most": 1000, "hole": 20, "pad": 2, "crop": {"pads": (1, 1, 1, 1), "row_guard": 1}}
    (gray,) = _blobs(ARGS, "/in/XA-1.png", limits, 1)
    gray[0, 0] = 250
    images = _df(spark, [gray]).withColumn("path", F.lit("/in/XA-1.png"))
    shown = {r.name: r for r in wing.calibrate_execute(spark, fields, images, **limits).collect()}
    assert set(shown) == {"gray", "thresh", "cropped_image"} and shown["gray"].px[0] == 190
    wing.calibrate_submit(spark, fields, images, f"{tmp_path}/params", block=5)
    (row,) = readers.read_params(spark, f"{tmp_path}/params").collect()
    assert row.folder == "XA" and tuple(row.gb_kernel) == (3, 5) and row.thresh_c == 3.0 and row.noise == pytest.approx(pipelines.noise_level(images, 5).first().noise)
