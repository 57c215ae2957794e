"""Per-raster algorithms that are sequential or iterative: numpy over Arrow batches, one raster row in, one row out.

No raster is exchanged between tasks.  Rasters of a batch that have the same shape
are worked on together.  A null raster gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _stacks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rasters as N x h x w) by shape."""
    h, w = batch.column("h").to_numpy(zero_copy_only=False), batch.column("w").to_numpy(zero_copy_only=False)
    px = batch.column("px")
    valid = px.is_valid().to_numpy(zero_copy_only=False)
    for shape in {(int(a), int(b)) for a, b, ok in zip(h, w, valid, strict=True) if ok}:
        rows = np.flatnonzero((h == shape[0]) & (w == shape[1]) & valid)
        flat = px.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), *shape)


def raster_map(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], element: str = "int") -> DataFrame:
    """Applies fn (N x h x w to N x h x w) to every raster."""
    kind = pa.int32() if element == "int" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, stack in _stacks(batch):
                for i, x in zip(rows.tolist(), fn(stack).reshape(len(rows), -1), strict=True):
                    out[i] = x
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("h"), batch.column("w"), pa.array(out, type=pa.list_(kind))], ["image_id", "h", "w", "px"])

    id_type = df.schema["image_id"].dataType.simpleString()
    return df.select("image_id", "h", "w", "px").mapInArrow(run, f"image_id {id_type}, h int, w int, px array<{element}>")


def raster_rows(df: DataFrame, fn: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows (image_id, *fn's columns) that fn finds in each raster (h x w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, columns = [], [[] for _ in columns_of]
            names = batch.column("image_id").to_pylist()
            for rows, stack in _stacks(batch):
                for i, x in zip(rows.tolist(), stack, strict=True):
                    for found in fn(x):
                        ids.append(names[i])
                        for column, value in zip(columns, found, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=batch.column("image_id").type), *(pa.array(c, type=t) for c, (_, t) in zip(columns, columns_of, strict=True))], ["image_id", *(n for n, _ in columns_of)])

    simple = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    columns_of = [(n, simple[t]) for n, t in (x.split() for x in schema.split(","))]
    id_type = df.schema["image_id"].dataType.simpleString()
    return df.select("image_id", "h", "w", "px").mapInArrow(run, f"image_id {id_type}, {schema}")


def shifted(stack: np.ndarray, dr: int, dc: int, fill: float = 0) -> np.ndarray:
    """The pixel dr rows and dc columns away, fill outside."""
    n, h, w = stack.shape
    out = np.full_like(stack, fill)
    r0, r1, c0, c1 = max(0, -dr), min(h, h - dr), max(0, -dc), min(w, w - dc)
    if r0 < r1 and c0 < c1:
        out[:, r0:r1, c0:c1] = stack[:, r0 + dr : r1 + dr, c0 + dc : c1 + dc]
    return out


def component_labels(stack: np.ndarray) -> np.ndarray:
    """8-connected components of on-pixels: 1 + the smallest pixel number of the component, 0 off."""
    n, h, w = stack.shape
    on = stack > 0
    big = h * w + 1
    label = np.where(on, np.arange(1, h * w + 1).reshape(1, h, w), big)
    while True:
        least = label
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                if dr or dc:
                    least = np.minimum(least, shifted(label, dr, dc, big))
        least = np.where(on, least, big)
        # follow the label to its own label: distances halve instead of shrinking by one
        flat = np.concatenate((np.full((n, 1), big), least.reshape(n, -1), np.full((n, 1), big)), axis=1)
        least = np.where(on, np.take_along_axis(flat, least.reshape(n, -1), axis=1).reshape(n, h, w), big)
        if (least == label).all():
            return np.where(on, label, 0).astype(np.int32)
        label = least


def components(df: DataFrame) -> DataFrame:
    return raster_map(df, component_labels)


def clahe_stack(stack: np.ndarray, clip: float = 2.0, grid: tuple[int, int] = (2, 2)) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of 0 to 255 rasters.

    Tile histograms are clipped at max(1, clip * tile pixels / 256), what is cut off is dealt out evenly (the rest one by
    one at equal steps), the tile tables are scaled cumulative sums, and each pixel blends its four nearest tables.
    """
    n, h, w = stack.shape
    gr, gc = grid
    th, tw = -(-h // gr), -(-w // gc)
    padded = np.pad(stack, ((0, 0), (0, th * gr - h), (0, tw * gc - w)), mode="reflect" if min(h, w) > 1 else "edge")
    area = th * tw
    limit = max(1, int(clip * area / 256)) if clip > 0 else area
    tables = np.zeros((n, gr, gc, 256))
    for a in range(gr):
        for b in range(gc):
            tile = padded[:, a * th : (a + 1) * th, b * tw : (b + 1) * tw].reshape(n, -1).astype(np.int64)
            for k in range(n):
                hist = np.bincount(tile[k], minlength=256)
                over = int(np.maximum(hist - limit, 0).sum())
                hist = np.minimum(hist, limit) + over // 256
                rest = over % 256
                if rest:
                    hist[np.arange(rest) * max(1, 256 // rest)] += 1
                tables[k, a, b] = np.clip(np.rint(np.cumsum(hist) * (255.0 / area)), 0, 255)
    fr, fc = (np.arange(h) / th - 0.5), (np.arange(w) / tw - 0.5)
    r0, c0 = np.floor(fr).astype(int), np.floor(fc).astype(int)
    wr, wc = fr - r0, fc - c0
    pick = lambda r, c: tables[np.arange(n)[:, None, None], np.clip(r, 0, gr - 1)[None, :, None], np.clip(c, 0, gc - 1)[None, None, :], stack.astype(int)]
    top = pick(r0, c0) * (1 - wc) + pick(r0, c0 + 1) * wc
    low = pick(r0 + 1, c0) * (1 - wc) + pick(r0 + 1, c0 + 1) * wc
    return np.clip(np.rint(top * (1 - wr)[None, :, None] + low * wr[None, :, None]), 0, 255)


def clahe(df: DataFrame, clip: float = 2.0, grid: tuple[int, int] = (2, 2)) -> DataFrame:
    return raster_map(df, lambda stack: clahe_stack(stack, clip, grid))


def denoise_stack(stack: np.ndarray, strength: float = 10.0, template: int = 3, search: int = 5) -> np.ndarray:
    """Non-local means: each pixel is the mean of the search window, weighted by exp(-patch distance / strength^2)."""
    n, h, w = stack.shape
    t, s = template // 2, search // 2
    x = np.pad(stack.astype(np.float64), ((0, 0), (t + s, t + s), (t + s, t + s)), mode="symmetric")
    view = lambda dr, dc, m: x[:, s + t + dr - m : s + t + dr + h + m, s + t + dc - m : s + t + dc + w + m]
    total, weight = np.zeros((n, h, w)), np.zeros((n, h, w))
    here = view(0, 0, t)
    for dr in range(-s, s + 1):
        for dc in range(-s, s + 1):
            square = (view(dr, dc, t) - here) ** 2
            sums = np.pad(square.cumsum(1).cumsum(2), ((0, 0), (1, 0), (1, 0)))
            k = 2 * t + 1
            d = (sums[:, k:, k:] - sums[:, :-k, k:] - sums[:, k:, :-k] + sums[:, :-k, :-k]) / (k * k)
            own = np.exp(-np.maximum(d, 0) / (strength * strength))
            total += own * view(dr, dc, 0)
            weight += own
    return np.rint(total / weight)


def denoise_nlm(df: DataFrame, strength: float = 10.0, template: int = 3, search: int = 5) -> DataFrame:
    return raster_map(df, lambda stack: denoise_stack(stack, strength, template, search))


def thin_stack(stack: np.ndarray) -> np.ndarray:
    """Skeletons one pixel wide by two alternating deletion passes over all 8-neighbourhoods until nothing changes."""
    on = (stack > 0).astype(np.int8)
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    while True:
        before = on
        for step in (0, 1):
            p = [shifted(on, dr, dc) for dr, dc in ring]
            count = sum(p)
            turns = sum(((p[i] == 0) & (p[(i + 1) % 8] == 1)).astype(np.int8) for i in range(8))
            north, east, south, west = p[0], p[2], p[4], p[6]
            gone = (north * east * south == 0) & (east * south * west == 0) if step == 0 else (north * east * west == 0) & (north * south * west == 0)
            on = np.where((on == 1) & (count >= 2) & (count <= 6) & (turns == 1) & gone, 0, on).astype(np.int8)
        if (on == before).all():
            return on.astype(np.int32) * 255


def thin(df: DataFrame) -> DataFrame:
    return raster_map(df, thin_stack)


def outer_contours(raster: np.ndarray) -> list[tuple[int, float, int]]:
    """(label, polygon area, boundary pixels) of the outer border of each 8-connected component, by border following."""
    labels = component_labels(raster[None])[0]
    h, w = raster.shape
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    out = []
    for label in np.unique(labels[labels > 0]).tolist():
        start = divmod(label - 1, w)
        path, here, back = [start], start, 4
        first = None
        while True:
            for k in range(1, 9):
                d = (back + k) % 8
                r, c = here[0] + steps[d][0], here[1] + steps[d][1]
                if 0 <= r < h and 0 <= c < w and labels[r, c] == label:
                    break
            else:
                break
            if here == start and first == d:
                break
            if first is None:
                first = d
            here, back = (r, c), (d + 4) % 8
            path.append(here)
        area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(path, path[1:] + path[:1], strict=True))) / 2
        out.append((label, area, len(set(path))))
    return out


def contours(df: DataFrame) -> DataFrame:
    """image_id, label, area, n_border of every outer contour."""
    return raster_rows(df, outer_contours, "label int, area double, n_border int")
