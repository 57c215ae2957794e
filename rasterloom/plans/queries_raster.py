"""Queries of the pixel, stencil, region, point and name operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixel as px
from ..operators import anomaly, graph, kernels, lookup, points, regions, stencil
from ..sources import fixtures as fx
from . import pipelines
from .registry import query

S = SparkSession


def _pixels(spark: S, sf: str) -> DataFrame:
    return fx.pixels(fx.gray(spark, sf), "h", "w")


def _mapped(spark: S, sf: str, expr) -> DataFrame:
    return _pixels(spark, sf).select("image_id", "r", "c", expr.alias("v"))


@query("q_gray_from_bgr", f"WITH {fx.GRAY} SELECT image_id, r, c, CAST(round(v * 0.114 + ((v * 7 + 13) % 256) * 0.587 + ((v * 3 + 29) % 256) * 0.299) AS INTEGER) AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.gray_from_bgr(F.col("v"), (F.col("v") * 7 + 13) % 256, (F.col("v") * 3 + 29) % 256))


@query("q_highlight_replace", f"WITH {fx.GRAY} SELECT image_id, r, c, CASE WHEN v BETWEEN 245 AND 255 THEN 190 ELSE v END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.replace_highlights(F.col("v")))


@query("q_threshold_binary", f"WITH {fx.GRAY} SELECT image_id, r, c, CASE WHEN v > 127 THEN 255 ELSE 0 END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.threshold(F.col("v")))


@query("q_threshold_inverse", f"WITH {fx.GRAY} SELECT image_id, r, c, CASE WHEN v > 127 THEN 0 ELSE 255 END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.threshold(F.col("v"), 127, 0, 255))


@query("q_threshold_unit", f"WITH {fx.GRAY} SELECT image_id, r, c, CASE WHEN v > 127 THEN 1 ELSE 0 END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.threshold(F.col("v"), 127, 1, 0))


@query("q_normalize_unit", f"WITH {fx.GRAY} SELECT image_id, r, c, v / 255.0 AS v{{r}} FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.unit_range(F.col("v")))


@query("q_normalize_signed", f"WITH {fx.GRAY} SELECT image_id, r, c, (v / 255.0 - 0.5) / 0.5 AS v{{r}} FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.signed_range(F.col("v")))


@query("q_mask_and", f"WITH {fx.GRAY} SELECT image_id, r, c, v & CASE WHEN (r + c) % 2 = 0 THEN 255 ELSE 15 END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.mask_and(F.col("v"), F.when((F.col("r") + F.col("c")) % 2 == 0, 255).otherwise(15)))


@query("q_invert", f"WITH {fx.GRAY} SELECT image_id, r, c, 255 - v AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.invert(F.col("v")))


@query("q_zero_frame", f"WITH {fx.GRAY} SELECT image_id, r, c, CASE WHEN r IN (0, 7) OR c IN (0, 7) THEN 0 ELSE v END AS v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    return _mapped(spark, sf, px.clear_frame(F.col("v"), F.col("r"), F.col("c"), F.col("h"), F.col("w")))


@query("q_image_mean", f"WITH {fx.GRAY} SELECT image_id, avg(v) AS mean{{r}} FROM g GROUP BY image_id")
def _(spark: S, sf: str) -> DataFrame:
    return fx.gray(spark, sf).select("image_id", (F.aggregate("px", F.lit(0.0), lambda a, x: a + x) / F.size("px")).alias("mean"))


@query("q_flatten_vectors", f"WITH {fx.GRAY} SELECT image_id, r * 8 + c AS i, v FROM g")
def _(spark: S, sf: str) -> DataFrame:
    rows = fx.gray(spark, sf).select("image_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("px", r * 8 + 1, F.lit(8)))).alias("px"))
    return rows.select("image_id", F.posexplode("px").alias("i", "v"))


def _weights(k: int) -> str:
    return ", ".join(f"({j}, CAST({w!r} AS DOUBLE))" for j, w in zip(range(-(k // 2), k - k // 2), stencil.gaussian_weights(k), strict=True))


def _blur_sql(k: int, reflect: bool) -> str:
    at = lambda x: f"CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 7 THEN 14 - ({x}) ELSE {x} END" if reflect else f"greatest(0, least(7, {x}))"
    return f"""{fx.GRAY}, k(o, w) AS (VALUES {_weights(k)}),
blur AS (SELECT a.image_id, a.r, a.c, any_value(a.v) AS own, sum(y.w * x.w * b.v) AS v FROM g a CROSS JOIN k y CROSS JOIN k x
  JOIN g b ON b.image_id = a.image_id AND b.r = {at('a.r + y.o')} AND b.c = {at('a.c + x.o')} GROUP BY a.image_id, a.r, a.c)"""


@query("q_gaussian_blur", f"WITH {_blur_sql(3, True)} SELECT image_id, r, c, v AS v{{r}} FROM blur")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.gaussian_blur(fx.gray(spark, sf), 3))


ADAPTIVE = f"{_blur_sql(5, False)}, thr AS (SELECT image_id, r, c, CASE WHEN own <= round(v - 5, 6) THEN 255 ELSE 0 END AS v FROM blur)"


@query("q_adaptive_threshold", f"WITH {ADAPTIVE} SELECT image_id, r, c, v FROM thr")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.adaptive_threshold(fx.gray(spark, sf), 5, 5.0))


@query("q_noise_level", f"WITH {ADAPTIVE} SELECT image_id, avg(v) AS noise{{r}} FROM thr GROUP BY image_id")
def _(spark: S, sf: str) -> DataFrame:
    return pipelines.noise_level(fx.gray(spark, sf), 5, 5.0)


def _extreme_sql(out: str, source: str, agg: str, k: int) -> str:
    low, high = -(k // 2), k - k // 2 - 1
    return f"{out} AS (SELECT a.image_id, a.r, a.c, {agg}(n.v) AS v FROM {source} a JOIN {source} n ON n.image_id = a.image_id AND n.r - a.r BETWEEN {low} AND {high} AND n.c - a.c BETWEEN {low} AND {high} GROUP BY a.image_id, a.r, a.c)"


def _chain(*steps: tuple[str, int]) -> str:
    source, parts = "b", [fx.BIN]
    for i, (agg, k) in enumerate(steps):
        parts.append(_extreme_sql(f"s{i}", source, agg, k))
        source = f"s{i}"
    return f"WITH {', '.join(parts)} SELECT image_id, r, c, v FROM {source}"


@query("q_morph_open", _chain(("min", 2), ("max", 2)))
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.morph_open(fx.binary(spark, sf), (2, 2)))


@query("q_morph_close", _chain(("max", 3), ("min", 3)))
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.morph_close(fx.binary(spark, sf), (3, 3)))


@query("q_remove_noise", _chain(("min", 2), ("max", 2), ("max", 3), ("min", 3)))
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.remove_noise(fx.binary(spark, sf), (2, 2), (3, 3)))


@query("q_clahe")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(kernels.clahe(fx.gray(spark, sf), 4.0, (2, 2)))


@query(
    "q_sobel_std",
    f"""WITH {fx.GRAY}, t AS (SELECT image_id, r, c, CASE WHEN v > 127 THEN 255.0 ELSE 0.0 END AS v FROM g),
k(dr, dc, wx, wy) AS (VALUES (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)),
m AS (SELECT a.image_id, a.r, a.c, sum(k.wx * n.v) / 4.0 AS gx, sum(k.wy * n.v) / 4.0 AS gy FROM t a CROSS JOIN k
  JOIN t n ON n.image_id = a.image_id AND n.r = greatest(0, least(7, a.r + k.dr)) AND n.c = greatest(0, least(7, a.c + k.dc)) GROUP BY a.image_id, a.r, a.c)
SELECT image_id, stddev_pop(sqrt(CAST(gx * gx + gy * gy AS DOUBLE) / 2)) AS edge_std{{r}} FROM m GROUP BY image_id""",
)
def _(spark: S, sf: str) -> DataFrame:
    return stencil.sobel_std(fx.gray(spark, sf))


@query(
    "q_neighbours",
    f"""WITH {fx.BIN} SELECT a.image_id, a.r, a.c, CASE WHEN n.r < a.r THEN n.c - a.c + 1 WHEN n.r = a.r THEN CASE WHEN n.c < a.c THEN 3 ELSE 4 END ELSE n.c - a.c + 6 END AS ord, n.r AS nr, n.c AS nc
FROM b a JOIN b n ON n.image_id = a.image_id AND abs(n.r - a.r) <= 1 AND abs(n.c - a.c) <= 1 AND NOT (n.r = a.r AND n.c = a.c) WHERE a.v = 1 AND n.v = 1""",
)
def _(spark: S, sf: str) -> DataFrame:
    return stencil.neighbours(fx.binary(spark, sf))


_PATTERNS = ", ".join(f"({p}, {dr}, {dc})" for p, pattern in enumerate(stencil.JUNCTIONS) for dr, dc in pattern)
JUNCTIONS = f"""{fx.BIN}, k(p, dr, dc) AS (VALUES {_PATTERNS}),
hits AS (SELECT a.image_id, a.r, a.c, k.p, count(*) AS wanted, count(*) FILTER (WHERE n.v IS NULL OR n.v = 1) AS seen FROM b a CROSS JOIN k
  LEFT JOIN b n ON n.image_id = a.image_id AND n.r = a.r + k.dr AND n.c = a.c + k.dc WHERE a.v = 1 GROUP BY a.image_id, a.r, a.c, k.p),
jn AS (SELECT DISTINCT image_id, r, c FROM hits WHERE wanted = seen)"""


@query("q_junction_mask", f"WITH {JUNCTIONS} SELECT b.image_id, b.r, b.c, CASE WHEN jn.image_id IS NULL THEN 0 ELSE 1 END AS v FROM b LEFT JOIN jn ON jn.image_id = b.image_id AND jn.r = b.r AND jn.c = b.c")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.junction_mask(fx.binary(spark, sf)))


@query("q_junction_points", f"WITH {JUNCTIONS} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY r, c) - 1 AS INTEGER) AS ord, r, c FROM jn WHERE r NOT IN (0, 7) AND c NOT IN (0, 7)")
def _(spark: S, sf: str) -> DataFrame:
    return points.listed(points.off_frame(stencil.on_points(stencil.junction_mask(fx.binary(spark, sf)))))


def _near(op: str) -> str:
    return f"lambda p: sqrt((p.r - rest[1].r) * (p.r - rest[1].r) + (p.c - rest[1].c) * (p.c - rest[1].c)) {op} 3.0"


MERGED = f"""{JUNCTIONS}, sets AS (SELECT image_id, list({{'r': r, 'c': c}} ORDER BY r, c) AS ps FROM jn GROUP BY image_id),
walk AS (SELECT image_id, ps AS rest, CAST(-1 AS INTEGER) AS ord, CAST(NULL AS INTEGER) AS r, CAST(NULL AS INTEGER) AS c FROM sets
  UNION ALL SELECT image_id, list_filter(rest, {_near('>=')}), CAST(ord + 1 AS INTEGER),
    CAST(round_even(list_avg(list_transform(list_filter(rest, {_near('<')}), lambda p: p.r)), 0) AS INTEGER),
    CAST(round_even(list_avg(list_transform(list_filter(rest, {_near('<')}), lambda p: p.c)), 0) AS INTEGER)
  FROM walk WHERE len(rest) > 0),
merged AS (SELECT image_id, ord, r, c FROM walk WHERE ord >= 0)"""


@query("q_cleanup_points", f"WITH RECURSIVE {MERGED} SELECT image_id, ord, r, c FROM merged")
def _(spark: S, sf: str) -> DataFrame:
    return points.listed(points.merge_close(stencil.on_points(stencil.junction_mask(fx.binary(spark, sf))), 3.0))


@query("q_find_junctions", f"WITH RECURSIVE {MERGED} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INTEGER) AS ord, r, c FROM merged WHERE r NOT IN (0, 7) AND c NOT IN (0, 7)")
def _(spark: S, sf: str) -> DataFrame:
    return points.listed(points.find_junctions(fx.binary(spark, sf), 3.0))


@query(
    "q_nearest_node",
    f"""WITH RECURSIVE {MERGED} SELECT b.image_id, b.r, b.c, min(m.ord) AS node FROM b JOIN merged m ON m.image_id = b.image_id
AND sqrt((b.r - m.r) * (b.r - m.r) + (b.c - m.c) * (b.c - m.c)) < 2.5 WHERE b.v = 1 GROUP BY b.image_id, b.r, b.c""",
)
def _(spark: S, sf: str) -> DataFrame:
    b = fx.binary(spark, sf)
    nodes = points.listed(points.merge_close(stencil.on_points(stencil.junction_mask(b)), 3.0))
    return points.nearest_node(fx.pixels(b).filter("v = 1"), nodes, 2.5)


@query(
    "q_pattern_match",
    f"""WITH {JUNCTIONS}, ids AS (SELECT DISTINCT image_id AS a, image_id + 1 AS b FROM px WHERE image_id + 1 IN (SELECT image_id FROM px)),
t AS (SELECT ids.a, ids.b, jn.r, jn.c, EXISTS (SELECT 1 FROM jn o WHERE o.image_id = ids.b AND sqrt((o.r - jn.r) * (o.r - jn.r) + (o.c - jn.c) * (o.c - jn.c)) <= 1.5) AS hit
  FROM ids LEFT JOIN jn ON jn.image_id = ids.a)
SELECT a, b, CAST(count(*) FILTER (WHERE r IS NOT NULL AND hit) AS INTEGER) AS matched, CAST(count(r) AS INTEGER) AS total,
  count(r) > 0 AND count(*) FILTER (WHERE r IS NOT NULL AND hit) >= 0.8 * count(r) AS similar FROM t GROUP BY a, b""",
)
def _(spark: S, sf: str) -> DataFrame:
    p = stencil.on_points(stencil.junction_mask(fx.binary(spark, sf)))
    ids = p.select(F.col("image_id").alias("a"))
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a")), "a", "left_semi").withColumn("b", F.col("a") + 1)
    return points.pattern_match(p, pairs, 1.5, 0.8)


def _components_sql(source: str, cte: str) -> str:
    """comp(image_id, r, c, label) of the on-pixels of a table."""
    return f"""{cte}, reach(image_id, p, q) AS (SELECT image_id, r * 8 + c, r * 8 + c FROM {source} WHERE v > 0
  UNION SELECT s.image_id, s.p, n.r * 8 + n.c FROM reach s JOIN {source} n ON n.image_id = s.image_id AND n.v > 0 AND abs(n.r - s.q // 8) <= 1 AND abs(n.c - s.q % 8) <= 1),
comp AS (SELECT image_id, CAST(p // 8 AS INTEGER) AS r, CAST(p % 8 AS INTEGER) AS c, CAST(min(q) + 1 AS INTEGER) AS label FROM reach GROUP BY image_id, p)"""


COMP = _components_sql("b", fx.BIN)
STATS = f"{COMP}, stats AS (SELECT image_id, label, min(c) AS x, min(r) AS y, max(c) - min(c) + 1 AS width, max(r) - min(r) + 1 AS height, count(*) AS size, avg(c) AS cx, avg(r) AS cy FROM comp GROUP BY image_id, label)"


@query("q_components", f"WITH RECURSIVE {COMP} SELECT image_id, r, c, label AS v FROM comp")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(kernels.components(fx.binary(spark, sf))).filter("v > 0")


@query("q_component_stats", f"WITH RECURSIVE {STATS} SELECT image_id, label, x, y, width, height, size, cx AS cx{{r}}, cy AS cy{{r}} FROM stats")
def _(spark: S, sf: str) -> DataFrame:
    return regions.component_stats(fx.binary(spark, sf))


@query(
    "q_small_component_mask",
    f"""WITH RECURSIVE {STATS} SELECT b.image_id, b.r, b.c, CASE WHEN EXISTS (SELECT 1 FROM stats s WHERE s.image_id = b.image_id AND s.size <= 3 AND b.c BETWEEN s.x AND s.x + s.width AND b.r BETWEEN s.y AND s.y + s.height) THEN b.v ELSE 0 END AS v FROM b""",
)
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(regions.small_component_mask(fx.binary(spark, sf), 3))


_OFF = fx.BIN + ", o AS (SELECT image_id, r, c, 1 - v AS v FROM b)"


@query(
    "q_fill_small_holes",
    f"""WITH RECURSIVE {_components_sql('o', _OFF)}, big AS (SELECT image_id, label FROM comp GROUP BY image_id, label HAVING count(*) >= 10)
SELECT b.image_id, b.r, b.c, CASE WHEN big.label IS NULL THEN 255 ELSE 0 END AS v FROM b LEFT JOIN comp ON comp.image_id = b.image_id AND comp.r = b.r AND comp.c = b.c LEFT JOIN big ON big.image_id = comp.image_id AND big.label = comp.label""",
)
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(regions.fill_small_holes(fx.binary(spark, sf), 10))


SMALL = f"{STATS}, small AS (SELECT e.vec_id AS image_id, count(*) FILTER (WHERE s.size < 4) AS n_small FROM embeddings e LEFT JOIN stats s ON s.image_id = e.vec_id GROUP BY e.vec_id)"


@query("q_small_component_count", f"WITH RECURSIVE {SMALL} SELECT image_id, n_small FROM small")
def _(spark: S, sf: str) -> DataFrame:
    return regions.small_component_count(fx.binary(spark, sf), 4)


@query("q_noisy_images", f"WITH RECURSIVE {SMALL} SELECT image_id, n_small FROM small WHERE n_small > 3")
def _(spark: S, sf: str) -> DataFrame:
    return regions.noisy_images(regions.small_component_count(fx.binary(spark, sf), 4), "n_small", 3)


@query("q_contour_area")
def _(spark: S, sf: str) -> DataFrame:
    """Contours counted under an area, and the largest one."""
    c = kernels.contours(fx.binary(spark, sf))
    return c.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("area") < 2, 1).otherwise(0)).alias("n_small"), F.max("area").alias("largest"))


@query(
    "q_orientation",
    f"""WITH {fx.BIN} SELECT image_id, degrees(0.5 * atan2(2 * (round(covar_pop(r, c), 9) + 0.0), round(var_pop(r) - var_pop(c), 9) + 0.0)) AS angle{{r}} FROM b WHERE v = 1 GROUP BY image_id""",
    digits=4,
)
def _(spark: S, sf: str) -> DataFrame:
    return regions.orientation(fx.binary(spark, sf))


@query(
    "q_rotate_nearest",
    f"""WITH {fx.GRAY}, s AS (SELECT image_id, r, c, greatest(0, least(7, CAST(floor(round(cos(radians(30.0)) * (c - 4) - sin(radians(30.0)) * (r - 4) + 4, 6) + 0.5) AS INTEGER))) AS sc,
  greatest(0, least(7, CAST(floor(round(sin(radians(30.0)) * (c - 4) + cos(radians(30.0)) * (r - 4) + 4, 6) + 0.5) AS INTEGER))) AS sr FROM g),
t AS (SELECT s.image_id, s.r + 1 AS r, s.c + 1 AS c, g.v FROM s JOIN g ON g.image_id = s.image_id AND g.r = s.sr AND g.c = s.sc)
SELECT e.vec_id AS image_id, CAST(i // 10 AS INTEGER) AS r, CAST(i % 10 AS INTEGER) AS c, coalesce(t.v, 0) AS v FROM embeddings e CROSS JOIN range(0, 100) q(i) LEFT JOIN t ON t.image_id = e.vec_id AND t.r = i // 10 AND t.c = i % 10""",
)
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(stencil.rotate_nearest(fx.gray(spark, sf), F.lit(30.0), 1))


@query(
    "q_resize",
    f"""WITH {fx.GRAY}, n AS (SELECT g.image_id, CAST(i // 12 AS INTEGER) AS r, CAST(i % 12 AS INTEGER) AS c, g.v FROM range(0, 144) q(i) JOIN g ON g.r = (i // 12) * 8 // 12 AND g.c = (i % 12) * 8 // 12)
SELECT 'nearest' AS kind, image_id, r, c, CAST(v AS DOUBLE) AS v{{r}} FROM n UNION ALL SELECT 'mean', image_id, CAST(r // 2 AS INTEGER), CAST(c // 2 AS INTEGER), avg(v) FROM g GROUP BY image_id, r // 2, c // 2""",
)
def _(spark: S, sf: str) -> DataFrame:
    g = fx.gray(spark, sf)
    near = fx.pixels(stencil.resize_nearest(g, 12, 12)).select(F.lit("nearest").alias("kind"), "image_id", "r", "c", F.col("v").cast("double").alias("v"))
    return near.unionByName(fx.pixels(stencil.resize_mean(g, 2)).select(F.lit("mean").alias("kind"), "image_id", "r", "c", "v"))


@query(
    "q_crop_rules",
    f"""WITH {fx.NAMES}, u AS (SELECT *, CASE WHEN contains(path, 'AT') THEN 150 ELSE 0 END + CASE WHEN contains(path, 'RO') THEN 150 ELSE 0 END
  + CASE WHEN contains(path, 'HU') AND NOT contains(path, '2019') THEN 170 ELSE 0 END + CASE WHEN contains(path, 'HU') AND contains(path, '2019') THEN 100 ELSE 0 END
  + CASE WHEN contains(path, 'MD') THEN 100 ELSE 0 END
  + CASE WHEN NOT contains(path, 'PL') THEN 0 WHEN width > 1000 THEN 400 WHEN width > 800 AND width < 1000 THEN 200 WHEN width > 600 AND width < 800 THEN 10 ELSE 0 END AS cut FROM nm)
SELECT doc_id, width, cut, greatest(0, width - cut) AS new_width, CASE WHEN NOT contains(path, 'PL') THEN 0.0 WHEN width > 1000 THEN width * 35 / 100.0 WHEN width > 800 AND width < 1000 THEN width * 25 / 100.0 WHEN width > 600 AND width < 800 THEN width * 15 / 100.0 ELSE 0.0 END AS fallback{{r}} FROM u""",
)
def _(spark: S, sf: str) -> DataFrame:
    cut = regions.crop_columns(F.col("path"), F.col("width"))
    return fx.names(spark, sf).select("doc_id", "width", cut.alias("cut"), F.greatest(F.lit(0), F.col("width") - cut).alias("new_width"), regions.left_fallback(F.col("path"), F.col("width")).alias("fallback"))


@query(
    "q_junction_bbox_crop",
    f"""WITH {JUNCTIONS}, box AS (SELECT image_id, min(c) - 1 AS l, min(r) - 1 AS t, max(c) FILTER (WHERE c < 6) + 1 AS rr, max(r) FILTER (WHERE r < 7) + 1 AS bb FROM jn GROUP BY image_id),
cb AS (SELECT image_id, greatest(0, l) AS x1, least(8, rr) AS x2, greatest(0, t) AS y1, least(8, bb) AS y2 FROM box WHERE rr IS NOT NULL AND bb IS NOT NULL)
SELECT b.image_id, b.r - cb.y1 AS r, b.c - cb.x1 AS c, b.v FROM b JOIN cb ON cb.image_id = b.image_id AND b.r >= cb.y1 AND b.r < cb.y2 AND b.c >= cb.x1 AND b.c < cb.x2""",
)
def _(spark: S, sf: str) -> DataFrame:
    b = fx.binary(spark, sf)
    box = regions.junction_box(stencil.on_points(stencil.junction_mask(b)), (1, 1, 1, 1), 2, 1)
    return fx.pixels(regions.crop(b, box).filter("px is not null"))


@query(
    "q_upper_border",
    f"""WITH {fx.OCC}, days(d) AS (SELECT * FROM range(0, 31)), n AS (SELECT i.image_id, d AS r, count(oc.c) AS n FROM (SELECT DISTINCT image_id FROM oc) i CROSS JOIN days LEFT JOIN oc ON oc.image_id = i.image_id AND oc.r = d AND oc.c >= 2 AND oc.c < 22 GROUP BY i.image_id, d),
s AS (SELECT image_id, r, n, lag(n) OVER (PARTITION BY image_id ORDER BY r) AS before FROM n), k AS (SELECT image_id, r FROM s WHERE before = 0 AND n > 1)
SELECT i.image_id, CAST(CASE WHEN count(k.r) = 2 THEN max(k.r) END AS INTEGER) AS border FROM (SELECT DISTINCT image_id FROM oc) i LEFT JOIN k ON k.image_id = i.image_id GROUP BY i.image_id""",
)
def _(spark: S, sf: str) -> DataFrame:
    return regions.upper_border(fx.occupancy(spark, sf), 2, 22, 1)


@query("q_leftmost_pixel", f"WITH {fx.OCC} SELECT image_id, min(c) AS leftmost FROM oc GROUP BY image_id")
def _(spark: S, sf: str) -> DataFrame:
    return regions.leftmost_pixel(fx.occupancy(spark, sf))


@query("q_thinning")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(kernels.thin(fx.blobs(spark, sf))).filter("v > 0")


@query("q_denoise_nlm")
def _(spark: S, sf: str) -> DataFrame:
    return fx.pixels(kernels.denoise_nlm(fx.gray(spark, sf), 40.0, 3, 5))


def _skeletons(spark: S, sf: str) -> DataFrame:
    return kernels.thin(fx.blobs(spark, sf))


@query("q_trace_graph")
def _(spark: S, sf: str) -> DataFrame:
    s = _skeletons(spark, sf)
    return graph.trace_graphs(s, points.find_junctions(s))


@query("q_region_graph")
def _(spark: S, sf: str) -> DataFrame:
    s = _skeletons(spark, sf)
    return graph.region_graphs(s, points.find_junctions(s))


@query("q_crop_full")
def _(spark: S, sf: str) -> DataFrame:
    s = _skeletons(spark, sf)
    paths = s.select("image_id", F.format_string("/data/in/XX-%d.png", "image_id").alias("path"))
    return fx.pixels(pipelines.crop_full(s, paths, (2, 2, 2, 2), 2, 2).filter("px is not null"))


@query(
    "q_param_nearest",
    """SELECT probe_id, ord, delta AS delta{r} FROM (SELECT c_custkey AS probe_id, s_suppkey AS ord, abs(s_acctbal - c_acctbal) AS delta,
  row_number() OVER (PARTITION BY c_custkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey) AS k FROM customer JOIN supplier ON s_nationkey = c_nationkey) q WHERE k = 1""",
)
def _(spark: S, sf: str) -> DataFrame:
    return lookup.nearest_params(fx.probes(spark, sf), fx.params(spark, sf))


@query("q_unprocessed_antijoin", f"WITH {fx.NAMES} SELECT doc_id, path FROM nm WHERE doc_id % 3 <> 0")
def _(spark: S, sf: str) -> DataFrame:
    n = fx.names(spark, sf)
    done = n.filter("doc_id % 3 = 0").select(F.regexp_replace("path", "^/data/in", "/data/out").alias("path"))
    return lookup.unprocessed(n, done).select("doc_id", "path")


@query("q_name_parse", f"WITH {fx.NAMES} SELECT doc_id, split_part(path, '/', 4) AS name, substring(split_part(path, '/', 4), 1, 2) AS region, contains(path, '2019') AS dated FROM nm")
def _(spark: S, sf: str) -> DataFrame:
    p = F.col("path")
    return fx.names(spark, sf).select("doc_id", px.base_name(p).alias("name"), px.region_code(p).alias("region"), p.contains("2019").alias("dated"))


@query("q_tuple_codec", f"WITH {fx.NAMES} SELECT doc_id, CAST(width % 50 - 9 AS INTEGER) AS a, CAST(doc_id % 31 AS INTEGER) AS b, '(' || (width % 50 - 9) || ',' || (doc_id % 31) || ')' AS text FROM nm")
def _(spark: S, sf: str) -> DataFrame:
    raw = F.format_string("( %d , %d)", (F.col("width") % 50 - 9).cast("int"), (F.col("doc_id") % 31).cast("int"))
    pair = fx.names(spark, sf).select("doc_id", px.parse_pair(raw).alias("p"))
    return pair.select("doc_id", "p.a", "p.b", px.format_pair(F.col("p")).alias("text"))


@query("q_args_cast", f"WITH {fx.NAMES} SELECT doc_id, CAST(width AS INTEGER) AS nlm_h, width / 10.0 AS clahe_cl{{r}}, CAST(width % 7 AS INTEGER) AS gb_a, CAST(width % 5 AS INTEGER) AS gb_b FROM nm")
def _(spark: S, sf: str) -> DataFrame:
    w = F.col("width")
    text = fx.names(spark, sf).select("doc_id", w.cast("string").alias("nlm_h"), (w / 10).cast("string").alias("clahe_cl"), F.concat(F.lit("("), (w % 7).cast("string"), F.lit(", "), (w % 5).cast("string"), F.lit(")")).alias("gb"))
    pair = px.parse_pair(F.col("gb"))
    return text.select("doc_id", F.col("nlm_h").try_cast("int").alias("nlm_h"), F.col("clahe_cl").try_cast("double").alias("clahe_cl"), pair["a"].alias("gb_a"), pair["b"].alias("gb_b"))


@query(
    "q_args_parse",
    f"""WITH {fx.NAMES} SELECT doc_id, path AS image_path, substring(split_part(path, '/', 4), 1, 2) AS folder_name, CAST(width AS INTEGER) AS nlm_h, CAST(width % 40 AS INTEGER) AS nlm_tws, CAST(width % 50 AS INTEGER) AS nlm_sws,
  '(' || (width % 7) || ',' || (width % 5) || ')' AS gb_kernel, width / 10.0 AS clahe_cl{{r}}, '(' || (width % 30) || ',' || (width % 20) || ')' AS clahe_tgs, CAST(width % 60 AS INTEGER) AS thresh_bs, -(width % 90) / 8.0 AS thresh_c{{r}},
  CASE WHEN width % 11 <> 0 THEN '(' || (width % 3) || ',2)' END AS morphx_kernel, '(2,' || (width % 4) || ')' AS kernel_open, '(' || (width % 6) || ',-5)' AS kernel_close, 'gray|thresh' || (width % 2) AS debug_args, '/data/out' AS output_destination FROM nm""",
)
def _(spark: S, sf: str) -> DataFrame:
    """All fields of a calibration as typed in: blanks, signs, and a kernel that is none."""
    w = F.col("width")
    n = fx.names(spark, sf)
    pair = lambda a, b: F.concat(F.lit("( "), a.cast("string"), F.lit(" ,"), b.cast("string"), F.lit(")"))
    text = {"image_path": F.col("path"), "folder_name": px.region_code(F.col("path")), "nlm_h": F.concat(F.lit(" "), w.cast("string")), "nlm_tws": (w % 40).cast("string"), "nlm_sws": (w % 50).cast("string"), "gb_kernel": pair(w % 7, w % 5), "clahe_cl": (w / 10).cast("string"), "clahe_tgs": pair(w % 30, w % 20), "thresh_bs": (w % 60).cast("string"), "thresh_c": (-(w % 90) / 8).cast("string")}
    text |= {"morphx_kernel": F.when(w % 11 != 0, pair(w % 3, F.lit(2))).otherwise("3x3"), "kernel_open": pair(F.lit(2), w % 4), "kernel_close": pair(w % 6, F.lit(-5)), "debug_args": F.concat(F.lit("gray, thresh"), (w % 2).cast("string")), "output_destination": F.lit("/data/out")}
    read = px.parse_args(text)
    kinds = dict(px.CALIBRATION)
    flat = {"pair": px.format_pair, "names": lambda c: F.array_join(c, "|")}
    shown = [F.when(c.isNotNull(), flat[kinds[k]](c)).alias(k) if kinds[k] in flat else c.alias(k) for k, c in read.items()]
    return n.select("doc_id", *shown)


@query("q_param_csv_parse", "SELECT s_suppkey AS ord, CAST(s_nationkey AS VARCHAR) AS folder, s_acctbal AS noise{r}, CAST(s_suppkey % 40 AS INTEGER) AS nlm_h, CAST(s_suppkey % 9 AS INTEGER) AS kernel_a, CAST(s_suppkey % 4 AS INTEGER) AS kernel_b FROM supplier")
def _(spark: S, sf: str) -> DataFrame:
    p = fx.params(spark, sf)
    o = F.col("ord")
    line = F.concat_ws(",", o.cast("string"), F.col("folder").cast("string"), F.col("noise").cast("string"), (o % 40).cast("string"), F.concat(F.lit('"('), (o % 9).cast("string"), F.lit(", "), (o % 4).cast("string"), F.lit(')"')))
    row = F.from_csv(line, F.lit("ord BIGINT, folder STRING, noise DOUBLE, nlm_h INT, kernel STRING"))
    pair = px.parse_pair(F.col("row.kernel"))
    return p.select(row.alias("row")).select("row.ord", "row.folder", "row.noise", "row.nlm_h", pair["a"].alias("kernel_a"), pair["b"].alias("kernel_b"))


@query("q_annotation_json", f"WITH {fx.LABEL} SELECT 'img-' || doc_id || '.png' AS name, CASE WHEN truth = 1 THEN 'normal' ELSE 'anomalous' END AS label FROM lb")
def _(spark: S, sf: str) -> DataFrame:
    b = fx.labelled(spark, sf).select(F.format_string("img-%d.png", "doc_id").alias("name"), F.when(F.col("truth") == 1, "normal").otherwise("anomalous").alias("label"), (F.col("doc_id") % 16).alias("file"))
    files = b.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "label")))).alias("json"))
    return files.select(F.explode(F.from_json("json", "map<string,string>")).alias("name", "label"))


@query(
    "q_annotation_metrics",
    f"""WITH {fx.LABEL}, k AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE truth = 1 AND prediction = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE truth = 0 AND prediction = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE truth = 1 AND prediction = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE truth = 0 AND prediction = 0) AS DOUBLE) AS tn FROM lb)
SELECT n, (tp + tn) / n AS accuracy{{r}}, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision{{r}}, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall{{r}}, 2 * tp / (2 * tp + fp + fn) AS f1{{r}} FROM k""",
)
def _(spark: S, sf: str) -> DataFrame:
    return anomaly.binary_metrics(fx.labelled(spark, sf))


@query("q_error_quarantine", f"WITH {fx.NAMES} SELECT coalesce(CASE WHEN width < 100 THEN 'too narrow' WHEN contains(path, 'MD') AND width < 400 THEN 'no margin' END, 'ok') AS status, count(*) AS n FROM nm GROUP BY 1")
def _(spark: S, sf: str) -> DataFrame:
    w = F.col("width")
    s = lookup.with_status(fx.names(spark, sf), [("too narrow", w < 100), ("no margin", F.col("path").contains("MD") & (w < 400))])
    good, bad = lookup.quarantine(s)
    return good.agg(F.count("*").alias("n")).select(F.lit("ok").alias("status"), "n").filter("n > 0").unionByName(bad.groupBy(F.col("error").alias("status")).agg(F.count("*").alias("n")))


@query("q_main_job")
def _(spark: S, sf: str) -> DataFrame:
    """Every image filtered with the parameters of its folder's nearest noise level: size and on-pixels of its skeleton, or
    the error."""
    from . import wing

    kernels_of = lambda a, b: {"a": a, "b": b}
    rows = [(folder, noise, ord_, 10 + ord_, 3, 5, kernels_of(3, 3), 2.0, kernels_of(2, 2), 3 if ord_ < 5 else 4, 2.0 - ord_ / 4, kernels_of(2, 2), kernels_of(1, 1 + ord_ % 2), kernels_of(2, 2)) for ord_, (folder, noise) in enumerate([("VA", 20.0), ("VA", 60.0), ("VB", 40.0), ("VC", 10.0), ("VC", 90.0), ("VD", 40.0)])]
    pair = "struct<a:int,b:int>"
    params = spark.createDataFrame(rows, f"folder string, noise double, ord long, nlm_h int, nlm_tws int, nlm_sws int, gb_kernel {pair}, clahe_cl double, clahe_tgs {pair}, thresh_bs int, thresh_c double, morphx_kernel {pair}, kernel_open {pair}, kernel_close {pair}")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("VA", "VB", "VC", "VD", "VE")]), (F.col("image_id") % 5).cast("int") + 1)  # VE has none
    images = fx.blobs(spark, sf).withColumn("px", F.transform("px", lambda v: 235 - 200 * v)).withColumn("path", F.concat(F.lit("/data/in/"), prefix, F.lit("-"), F.col("image_id").cast("string"), F.lit(".png")))
    done = images.filter("image_id % 9 = 0").select("path")
    good, bad = wing.filter_images(images, params, done, block=5, c=5.0, hole=20, crop={"pads": (2, 2, 2, 2), "row_guard": 2, "edge": 2, "jump": 1})
    shown = good.select("path", "folder", "noise", "h", "w", F.size(F.filter("px", lambda v: v > 0)).alias("on_pixels"), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(bad.select("path", "folder", "noise", "error"), allowMissingColumns=True)


@query("q_pipeline_morphology")
def _(spark: S, sf: str) -> DataFrame:
    """On-pixels, components, junctions, orientation and edge noise of every raster."""
    return pipelines.morphology_profile(fx.gray(spark, sf), nearer_than=3.0)


@query("q_pipeline_skeleton")
def _(spark: S, sf: str) -> DataFrame:
    """The whole preprocessing chain from gray rasters to skeleton pixels."""
    return fx.pixels(pipelines.skeletons(fx.gray(spark, sf), pad=1, hole=3, block=3, c=2.0, search=3)).filter("v > 0")
