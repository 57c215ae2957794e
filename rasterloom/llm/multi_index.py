"""Embedding near-dedup with an inverted multi-index (operator 8).

Unit vectors are split into halves, each half has a codebook of its own (k-means on
a bounded sample), and the product of the codebooks is the grid of cells; every
vector is indexed in the cell of its two nearest codewords.  A query visits cells in
order of the sum of its two codeword distances (the multi-sequence order).  How many
it visits is the smallest number that finds the target share of the true neighbours
of sample vectors, in every band of cosines and for neighbours made near the threshold,
and the neighbours found are verified by cosine in double precision.

Equal vectors of one label are collapsed before and counted after, cells with many
vectors are split into blocks that each meet the cell's queries, and the probes of a
cell stream past one block at a time.  A meeting gives counts of links and the edges
of a spanning forest, never its pairs: a link is counted for the vector that visits,
and for the vector visited only if that one does not visit back.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .components import connected_components

SAMPLE = 16_384
BLOCK = 2_048
MAX_CODEWORDS = 1_024


def _ordered_cells(units: np.ndarray, books: tuple[np.ndarray, np.ndarray], t: int) -> np.ndarray:
    """The first t cells of each vector in order of the summed distances of its halves to their codewords.

    With both halves' codewords in order of distance, cell (i, j) has (i + 1)(j + 1) - 1 cells before it at least, so only
    pairs with (i + 1)(j + 1) <= t can be among the first t.
    """
    k = len(books[0])
    most = max(1, 4_000_000 // int(t * (1 + np.log(t)) + k))  # rows whose candidate cells are held at once
    if len(units) > most:
        return np.concatenate([_ordered_cells(units[s : s + most], books, t) for s in range(0, len(units), most)])
    half = units.shape[1] - units.shape[1] // 2
    t = min(t, k * k)
    order, dist = [], []
    for part, book in ((units[:, :half], books[0]), (units[:, half:], books[1])):
        d = (book * book).sum(1)[None, :] - 2.0 * (part @ book.T) + (part * part).sum(1)[:, None]
        o = np.argsort(d, axis=1, kind="stable")[:, : min(t, k)]
        order.append(o)
        dist.append(np.take_along_axis(d, o, axis=1))
    i, j = np.meshgrid(np.arange(min(t, k)), np.arange(min(t, k)), indexing="ij")
    ok = (i + 1) * (j + 1) <= t
    i, j = i[ok], j[ok]
    total = dist[0][:, i] + dist[1][:, j]
    first = np.argsort(total, axis=1, kind="stable")[:, :t]
    return np.take_along_axis(order[0], i[first], axis=1) * k + np.take_along_axis(order[1], j[first], axis=1)


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    book = x[rng.choice(len(x), size=k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.argmin((book * book).sum(1)[None, :] - 2.0 * (x @ book.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(book)
        np.add.at(total, near, x)
        some = n > 0
        book[some] = total[some] / n[some, None]
    return book


class MultiIndex:
    """Codebooks of both halves and the number of cells a query visits."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, k: int, threshold: float, target_recall: float, seed: int = 5):
        half = sample.shape[1] - sample.shape[1] // 2
        self.books = _kmeans(sample[:, :half], k, seed), _kmeans(sample[:, half:], k, seed + 1)
        rng = np.random.default_rng(seed)
        q = sample[rng.integers(0, len(sample), 400)]
        away = rng.standard_normal(q.shape)
        away -= (away * q).sum(1)[:, None] * q
        away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
        c = threshold + (1 - threshold) * 0.25
        groups = [(q, c * q + np.sqrt(1 - c * c) * away), *self._pairs(sample, labels, threshold)]  # neighbours near the threshold, always
        own = [_ordered_cells(partners, self.books, 1) for _, partners in groups]
        self.visits = k * k
        for t in (1, 2, 4, 8, 16, 24, 32, 48, 64, 96, *(n << i for i in range(6, 20) for n in (2, 3))):
            if t >= k * k:
                break
            if all(self._found(queries, cells, t) >= target_recall for (queries, _), cells in zip(groups, own, strict=True)):
                self.visits = t
                break

    def _found(self, queries: np.ndarray, own: np.ndarray, t: int) -> float:
        """Share of the queries whose partner's cell is among the first t."""
        hits = [(_ordered_cells(queries[s : s + 256], self.books, t) == own[s : s + 256]).any(axis=1) for s in range(0, len(queries), 256)]
        return float(np.concatenate(hits).mean())

    @staticmethod
    def _pairs(sample: np.ndarray, labels: np.ndarray, threshold: float, most: int = 4_000, each: int = 2, least: int = 50) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of true neighbours in bands of cosine from the threshold up, each to be found on its own.

        Every vector gives its weakest pairs (``each`` at most), so a tight group cannot crowd out the rest; a band takes
        its pairs spread evenly over the vectors.  Bands with few pairs join the next one; fewer than ``least`` decide nothing.
        """
        code = np.unique(labels, return_inverse=True)[1]
        a, b, c = [], [], []
        for s in range(0, len(sample), 512):
            cosine = sample[s : s + 512] @ sample.T
            near = (cosine >= threshold) & (code[s : s + 512, None] == code[None, :])
            i, j = np.nonzero(near)
            i, j = i[i + s != j], j[i + s != j]
            x = cosine[i, j]
            by = np.lexsort((x, i))
            i, j, x = i[by], j[by], x[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            a.append(i[place < each] + s)
            b.append(j[place < each])
            c.append(x[place < each])
        a, b, c = np.concatenate(a), np.concatenate(b), np.concatenate(c)
        band = np.searchsorted(threshold + (1 - threshold) * np.array([0.15, 0.3, 0.5, 0.75]), c, "right")
        out, held = [], np.zeros(0, dtype=np.int64)
        for k in range(5):
            held = np.concatenate((held, np.flatnonzero(band == k)))
            if len(held) >= least:
                held = held[:: -(-len(held) // (most // 5))]
                out.append((sample[a[held]], sample[b[held]]))
                held = np.zeros(0, dtype=np.int64)
        return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in double precision, shorter ones filled with zeros."""
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = column.offsets.to_numpy()
    lens = np.diff(offsets)
    if len(lens) and (lens == width).all():
        out = flat[offsets[0] : offsets[-1]].reshape(len(lens), width)
    else:
        out = np.zeros((len(lens), width))
        for i, (a, n) in enumerate(zip(offsets[:-1].tolist(), lens.tolist(), strict=True)):
            out[i, :n] = flat[a : a + n]
    scale = np.abs(out).max(axis=1, initial=0.0)  # squares of very large or small components stay finite
    out = out / np.where(scale > 0, scale, 1.0)[:, None]
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def _cells(nodes: DataFrame, index: MultiIndex, width: int) -> DataFrame:
    """node, part, vector, cells (the first is the vector's own)."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = _ordered_cells(_matrix(batch.column(2), width), index.books, index.visits).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cells"])

    return nodes.mapInArrow(assign, f"node long, part string, vector {dict(nodes.dtypes)['vector']}, copies long, cells array<int>")


class _Block:
    """The indexed vectors of a block and what its probes have found."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)

    def close(self) -> None:
        self.names, self.copies, self.units, self.cells = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.found = np.zeros(len(self.names), dtype=np.int64)
        self.group = np.arange(len(self.names))

    def meet(self, names: np.ndarray, copies: np.ndarray, units: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple]:
        """(node, other, links) columns of some probes; links count rows, so a vector with copies counts with all of them."""
        q, m = np.nonzero(units @ self.units.T >= threshold)
        other = names[q] != self.names[m]
        q, m = q[other], m[other]
        if not len(q):
            return
        yield names, None, np.bincount(q, weights=self.copies[m], minlength=len(names)).astype(np.int64)
        step = max(1, 4_000_000 // self.cells.shape[1])
        for s in range(0, len(q), step):
            x, y = q[s : s + step], m[s : s + step]
            once = ~(self.cells[y] == own[x, None]).any(axis=1)
            self.found += np.bincount(y[once], weights=copies[x[once]], minlength=len(self.found)).astype(np.int64)
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        yield names[q[start]], self.names[m[start]], None
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(q)], strict=True):
            groups = self.group[m[a:b]]
            if (groups != groups[0]).any():
                self.group[np.isin(self.group, groups)] = groups.min()

    def finish(self) -> Iterator[tuple]:
        some = self.found > 0
        yield self.names[some], None, self.found[some]
        hung = self.group != np.arange(len(self.group))
        yield self.names[hung], self.names[self.group[hung]], None


def _links(dealt: DataFrame, width: int, threshold: float) -> DataFrame:
    """Rows with b: edges that connect what links connect; rows with n: links of a, to be added up.

    dealt: part, cell, block, probe, node, copies, vector, cells; indexed vectors of a block first, with all cells they
    visit; probes after them, with their own cell alone.
    """

    def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for a, b, n in found:
            keep = np.ones(len(a), dtype=bool) if n is None else n > 0
            if keep.any():
                columns = [pa.array(a[keep]), *(pa.nulls(int(keep.sum()), pa.int64()) if x is None else pa.array(x[keep]) for x in (b, n))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, closed = None, None, False
        for batch in batches:
            parts = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            probe, node, copies = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            units, cells = _matrix(batch.column(6), width), batch.column(7)
            i = 0
            while i < len(parts):
                j = i
                while j < len(parts) and parts[j] == parts[i] and probe[j] == probe[i]:
                    j += 1
                if parts[i] != key:
                    if closed:
                        yield from rows(block.finish())
                    key, block, closed = parts[i], _Block(), False
                here = cells.slice(i, j - i).flatten().to_numpy().reshape(j - i, -1)
                if not probe[i]:
                    block.add(node[i:j], copies[i:j], units[i:j], here)
                elif block.parts:
                    if not closed:
                        block.close()
                        closed = True
                    for s in range(i, j, 1024):
                        e = min(s + 1024, j)
                        yield from rows(block.meet(node[s:e], copies[s:e], units[s:e], here[s - i : e - i, 0], threshold))
                i = j
        if closed:
            yield from rows(block.finish())

    return dealt.mapInArrow(meet, "a long, b long, n long")


def embedding_near_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, target_recall: float = 0.985, sample: int = SAMPLE, per_cell: int = 16) -> DataFrame:
    """Near copies among the vectors of a label.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included),
    kept (vec_id = component_id), one row per row of vectors.  Only vectors with equal labels and lengths are compared.
    Vectors that are null, empty, zero or hold null or non-finite components, and vectors with a null label, link with
    nothing.  A null vec_id links like any other, counts as larger than all ids, and has component_id null only if it
    reaches no id.  Rows with equal vectors are one node with many members; an empty table gives no rows; other columns
    are not read.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # as it is stored: half the bytes to send
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0)
    vector = F.when(F.coalesce(fine, F.lit(False)), F.transform("vector", lambda x: x + F.lit(0.0)).cast(kind))  # -0.0 as 0.0
    part = F.concat_ws("/", F.size(vector).cast("string"), "label")
    rows = rows.select("id", vector.alias("vector"), part.alias("part"))
    usable = rows.filter("vector is not null")
    sizes = usable.agg(F.count("*"), F.max(F.size("vector"))).first()
    alone = rows.filter("vector is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    if not sizes[0]:
        return alone
    width = int(sizes[1])
    # a node is a distinct vector of a part, named by a hash under which no two of them meet (a second hash tells)
    for seed in count():
        named = usable.withColumn("node", F.xxhash64("part", "vector", F.lit(seed)))
        twin = F.xxhash64(F.lit(seed), "vector", "part")
        nodes = core.checkpointed(named.groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("part").alias("part"), F.first("vector").alias("vector"), (F.min(twin) != F.max(twin)).alias("mixed")))
        if nodes.filter("mixed").isEmpty():
            break
        core.discard(nodes)
    picked = nodes.select("part", "vector").orderBy(F.xxhash64("node"), "node").limit(sample).toPandas()
    units = _matrix(pa.array(picked["vector"].tolist(), type=pa.list_(pa.float64())), width)
    k = int(min(MAX_CODEWORDS, max(2, (sizes[0] / per_cell) ** 0.5)))
    index = MultiIndex(units, picked["part"].to_numpy(), k, threshold, target_recall)
    celled = core.checkpointed(_cells(nodes.select("node", "part", "vector", "copies"), index, width))

    # cells with many vectors are split into blocks; every probe of the cell meets all of them
    own = celled.withColumn("cell", F.col("cells")[0])
    most = max(64, min(BLOCK, 16_000_000 // index.visits))
    split = core.checkpointed(own.groupBy("part", "cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("blocks")).filter("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    indexed = own.join(split, ["part", "cell"], "left").select("part", "cell", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(False).alias("probe"), "node", "copies", "vector", "cells")
    probing = own.select("part", "node", "copies", "vector", F.array("cell").alias("own"), F.explode("cells").alias("cell")).join(split, ["part", "cell"], "left")
    probing = probing.select("part", "cell", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("probe"), "node", "copies", "vector", F.col("own").alias("cells"))
    dealt = indexed.unionByName(probing).repartition("part", "cell", "block").sortWithinPartitions("part", "cell", "block", "probe")
    links = core.checkpointed(_links(dealt, width, threshold))

    weighed = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("outside"))
    component = connected_components(links.filter("b is not null"))
    counted = nodes.join(weighed, "node", "left").join(component, "node", "left").select("node", "least", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", F.col("node")).alias("component"))
    root = counted.groupBy("component").agg(F.min("least").alias("component_id"))
    member = counted.join(root, "component").select("node", "n_links", "component_id")
    out = named.join(member, "node").select(F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(alone)


def brute_force(ids: list, labels: list, vectors: list, threshold: float = 0.93) -> tuple[dict, set]:
    """(links of each id, linked pairs) over all pairs (small inputs)."""
    units = []
    for x in vectors:
        v = None if x is None or any(y is None for y in x) else np.asarray(x, dtype=np.float64)
        fine = v is not None and np.isfinite(v).all() and v.any()
        v = v / np.abs(v).max() if fine else None
        units.append(v / np.linalg.norm(v) if fine else None)
    pairs = set()
    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if labels[i] is not None and labels[i] == labels[j] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                pairs.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    links = dict.fromkeys(ids, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    return links, pairs
