"""Graphs from skeleton rasters: nodes are junctions, edges traced paths."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AROUND = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def trace_edges(on: np.ndarray, nodes: list[tuple[int, int]], reach: float = 5.0, clear: float = 2.0) -> list[tuple[int, int, float, int]]:
    """(source, target, straight length, path pixels) of the paths between nodes of a skeleton.

    From each node in order, each neighbouring on-pixel that no earlier path has used starts a breadth-first search that
    ends at the first pixel nearer than ``reach`` to another node (the first such node), leaving out pixels nearer than
    ``clear`` to the source.  Pixels of a path that reached a node are used.
    """
    h, w = on.shape
    # the nodes near each pixel, in node order, by one sweep over each node's disc
    near: dict[tuple[int, int], list[int]] = {}
    span = math.ceil(reach)
    for k, (r, c) in enumerate(nodes):
        for a in range(max(0, r - span), min(h, r + span + 1)):
            for b in range(max(0, c - span), min(w, c + span + 1)):
                if math.hypot(a - r, b - c) < reach:
                    near.setdefault((a, b), []).append(k)
    used: set[tuple[int, int]] = set()
    edges = []

    def white(p: tuple[int, int]) -> list[tuple[int, int]]:
        return [(p[0] + a, p[1] + b) for a, b in AROUND if 0 <= p[0] + a < h and 0 <= p[1] + b < w and on[p[0] + a, p[1] + b]]

    for source, place in enumerate(nodes):
        for start in white(place):
            if start in used:
                continue
            parent: dict[tuple[int, int], tuple[int, int] | None] = {place: None, start: None}
            queue, end = deque([start]), None
            while queue and end is None:
                here = queue.popleft()
                for p in white(here):
                    if p in parent or math.hypot(p[0] - place[0], p[1] - place[1]) < clear:
                        continue
                    reached = [k for k in near.get(p, ()) if nodes[k] != place]
                    parent[p] = here
                    if reached:
                        end = (p, reached[0])
                        break
                    queue.append(p)
            if end is not None:
                path, p = [], end[0]
                while p is not None:
                    path.append(p)
                    p = parent[p]
                used.update(path)
                if end[1] != source:
                    t = nodes[end[1]]
                    edges.append((source, end[1], math.hypot(place[0] - t[0], place[1] - t[1]), len(path)))
    return edges


def trace_graphs(rasters: DataFrame, junctions: DataFrame) -> DataFrame:
    """graph_id, src, dst, length, path_pixels: one row per undirected edge of each raster's graph (a later path between the
    same nodes replaces an earlier one)."""
    j = rasters.join(junctions.select("image_id", "points"), "image_id")
    kind = j.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for image, h, w, px, points in zip(*(batch.column(c).to_pylist() for c in ("image_id", "h", "w", "px", "points")), strict=True):
                if px is None or not points:
                    continue
                found = {}
                for a, b, length, n in trace_edges(np.array(px).reshape(h, w) > 0, [(p["r"], p["c"]) for p in points]):
                    found[min(a, b), max(a, b)] = length, n
                for (a, b), (length, n) in sorted(found.items()):
                    for column, value in zip(cols, (image, a, b, length, n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=batch.column("image_id").type), *(pa.array(c, type=t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.float64(), pa.int32()), strict=True))], ["graph_id", "src", "dst", "length", "path_pixels"])

    return j.select("image_id", "h", "w", "px", "points").mapInArrow(run, f"graph_id {kind}, src int, dst int, length double, path_pixels int")


def region_edges(on: np.ndarray, nodes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs of nodes whose zones touch: every on-pixel belongs to the node it reaches in the fewest steps (ties: the
    smaller node), and zones touch where neighbouring pixels belong to different nodes."""
    h, w = on.shape
    owner = np.full((h, w), -1)
    queue: deque = deque()
    for k, (r, c) in enumerate(nodes):
        if 0 <= r < h and 0 <= c < w and owner[r, c] < 0:
            owner[r, c] = k
            queue.append((r, c))
    while queue:
        layer, queue = list(queue), deque()
        claims: dict[tuple[int, int], int] = {}
        for r, c in layer:
            for a, b in AROUND:
                p = (r + a, c + b)
                if 0 <= p[0] < h and 0 <= p[1] < w and on[p] and owner[p] < 0:
                    claims[p] = min(claims.get(p, owner[r, c]), owner[r, c])
        for p, k in claims.items():
            owner[p] = k
            queue.append(p)
    pairs = set()
    for r in range(h):
        for c in range(w):
            for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):
                if r + a < h and 0 <= c + b < w and owner[r, c] >= 0 and owner[r + a, c + b] >= 0 and owner[r, c] != owner[r + a, c + b]:
                    pairs.add((min(owner[r, c], owner[r + a, c + b]), max(owner[r, c], owner[r + a, c + b])))
    return sorted((int(a), int(b)) for a, b in pairs)


def region_graphs(rasters: DataFrame, junctions: DataFrame) -> DataFrame:
    """graph_id, src, dst of the touching zones of each raster's junctions: independent of tracing order."""
    j = rasters.join(junctions.select("image_id", "points"), "image_id")
    kind = j.schema["image_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            for image, h, w, px, points in zip(*(batch.column(c).to_pylist() for c in ("image_id", "h", "w", "px", "points")), strict=True):
                if px is None or not points:
                    continue
                for a, b in region_edges(np.array(px).reshape(h, w) > 0, [(p["r"], p["c"]) for p in points]):
                    for column, value in zip(cols, (image, a, b), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=batch.column("image_id").type), pa.array(cols[1], type=pa.int32()), pa.array(cols[2], type=pa.int32())], ["graph_id", "src", "dst"])

    return j.select("image_id", "h", "w", "px", "points").mapInArrow(run, f"graph_id {kind}, src int, dst int")


def canonical(edges: DataFrame, weight: str) -> DataFrame:
    """Simple undirected edges: src < dst, one row per pair, no loops."""
    e = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight).filter("src <> dst")
    return e.groupBy("graph_id", "src", "dst").agg(F.max(weight).alias(weight))
