"""N-gram Jaccard self-join by universe partitioning (operator 4).

Sets of equal content are one class.  Sizes are cut into bands; a pair is looked for
in the band of its larger set, where at most H elements can differ.  The band cuts
the universe of token hashes into A exact segments and D segments (twice as wide)
that may differ by one element, with A + 2 D >= H + 1 + X: by the pigeonhole
principle two sets that link have an exact segment in common, or a wide one up to one
deletion.  Signatures are the hashes of the exact segments, and of the wide ones with
their one-deletion neighbourhoods.

Empty segments would be the hot signatures.  X is the coverage a set may give up: a
set whose empty exact segments (1 each) and wide segments with under two elements (2
each) come to X at most leaves out their empty signatures, any other set has them
all, so the pigeonhole still holds for every pair.  A, D and X are chosen for each
band by cost: expected signatures, from the sizes of all documents, plus expected
candidates from empty signatures.

Buckets of a signature are never expanded into all pairs.  First every member meets
the head of its bucket, the smallest member, which is a row for each row of the buckets
at most.  Links found are contracted, and what is left of the buckets without their heads
is compared in the task that has the bucket, across components only (a large bucket in
blocks, each pair of blocks once): first every set in its home, the largest of its
buckets, for its nearest partner, then, links contracted again, for all; at last members
of different homes in all buckets that still hold several components.  Before whole sets
are compared, bit sketches that can only underestimate a difference drop what cannot link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import core, repeats
from .components import connected_components

RATIO = 1.35
PAIR_COST = 6.0
#: Coverage a set may give up; long sets have tens of empty segments.
SLACKS = (*range(13), 14, 16, 18, 20, 23, 26, 30, 34, 39, 45, 52, 60, 70, 82, 96, 112, 130, 160, 200)


class Plan:
    """Bands and the allocation of each: arrays by band."""

    def __init__(self, sizes: dict[int, int], num: int, den: int):
        self.num, self.den = num, den
        top = max(sizes, default=1)
        edges = [1]
        while edges[-1] <= top:
            edges.append(max(edges[-1] + 1, int(edges[-1] * RATIO)))
        self.low = np.array(edges, dtype=np.int64)  # band i holds sizes low[i] to low[i + 1] - 1
        n = len(edges) - 1
        self.exact, self.wide, self.slack, self.used = (np.zeros(n, dtype=np.int64) for _ in range(4))
        for b in range(n):
            lo, hi = edges[b], edges[b + 1] - 1
            h = self.most_different(hi)
            least = self.smallest_partner(lo)
            here = sum(c for s, c in sizes.items() if least <= s <= hi)
            if h:
                self.used[b] = 1
                self.exact[b], self.wide[b], self.slack[b] = self.allocate(h, least, here)

    def shared(self, total: int) -> int:
        """Elements that two sets of total elements in all must share."""
        return -(-self.num * total // (self.num + self.den))

    def most_different(self, hi: int) -> int:
        return max(s - 2 * self.shared(s) for s in range(max(2, 2 * hi - 40), 2 * hi + 1))

    def smallest_partner(self, size: int) -> int:
        return max(1, -(-self.num * size // self.den))

    def largest_partner(self, size: np.ndarray) -> np.ndarray:
        return size * self.den // self.num

    def allocate(self, h: int, size: int, n: int) -> tuple[int, int, int]:
        best = None
        for x in SLACKS:
            units = h + 1 + x
            for d in sorted({0, 1, units // 4, units // 2, -(-units // 2)}):
                a = max(0, units - 2 * d)
                t1, t2 = size / (a + 2 * d), 2 * size / (a + 2 * d)
                lost = a * math.exp(-t1) + 2 * d * (1 + t2) * math.exp(-t2)
                # empty signatures of a set: what it loses, where that is over x (lost: a Poisson mean)
                term, below = math.exp(-lost), 0.0
                for k in range(x):
                    below += term
                    term *= lost / (k + 1)
                empties = lost * max(0.0, 1 - below)
                rows = n * (a + d * (2 + t2))
                cost = rows + PAIR_COST * (n * empties) ** 2 / (2 * (a + d))
                if best is None or cost < best[0]:
                    best = cost, a, d, x
        return best[1:]

    def bands(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.low, size, "right") - 1, len(self.used) - 1)


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct word n-grams, sorted by both."""
    words = core.Words(texts, core.SPACE_WORDS, core.LOWER)
    grams = core.rolling(words.hash, n)
    ok = words.doc[: len(grams)] == words.doc[n - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    doc, value = words.doc[: len(grams)][ok], core.mix64(grams[ok])
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [core.rolling_one(words.hash[words.first[d] : words.first[d + 1]].tolist()) for d in short]
        doc = np.concatenate((doc, short))
        value = np.concatenate((value, core.mix64(np.array(whole, dtype=core.U64) + counts[short].astype(core.U64))))
    edges = np.searchsorted(doc[: len(doc) - len(short)], np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        value[a:b].sort()
    if len(short):
        by = np.argsort(doc, kind="stable")
        doc, value = doc[by], value[by]
    keep = np.ones(len(doc), dtype=bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def fingerprints(doc: np.ndarray, value: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Set size and a 64-bit hash of the set of each document (0 for none)."""
    size = np.bincount(doc, minlength=n_docs)
    out = np.zeros(n_docs, dtype=core.U64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = core.mix64(np.add.reduceat(core.mix64(value ^ core.U64(core._MULT)), np.searchsorted(doc, some)) + size[some].astype(core.U64))
    return size, out


def signatures(plan: Plan, doc: np.ndarray, value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) of every set in all bands it can pair in."""
    found_d, found_s = [], []
    own = plan.bands(np.maximum(size, 1))
    last = plan.bands(np.maximum(plan.largest_partner(size), 1))
    high = value >> core.U64(32)
    mixed = core.mix64(value + core.U64(0x5851F42D4C957F2D))
    step = 0
    while True:
        band = own + step
        live = (size > 0) & (band <= last)
        if not live.any():
            break
        live &= plan.used[np.minimum(band, len(plan.used) - 1)] > 0
        step += 1
        if not live.any():
            continue
        mine = live[doc]
        d, h, m = doc[mine], high[mine], mixed[mine]
        b = band[d]
        a_, w_ = plan.exact[b], plan.wide[b]
        cell = ((h * (a_ + 2 * w_).astype(core.U64)) >> core.U64(32)).astype(np.int64)
        seg = np.where(cell < a_, cell, a_ + (cell - a_) // 2)
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(d)))
        total = np.add.reduceat(m, at)
        sd, ss = d[at], seg[at]
        salt = core.mix64(band[sd].astype(core.U64) * core.U64(1 << 32) + ss.astype(core.U64))
        found_d.append(sd)
        found_s.append(core.mix64(total + salt))
        wide = ss >= plan.exact[band[sd]]
        # what the set gives up: empty exact segments, wide ones with under two elements
        exact_here = np.bincount(sd[~wide], minlength=len(size))
        wide_here = np.bincount(sd[wide & (count > 1)], minlength=len(size))
        at_band = np.minimum(band, len(plan.used) - 1)
        lost = np.where(live, plan.exact[at_band] - exact_here + 2 * (plan.wide[at_band] - wide_here), 0)
        full = live & (lost > plan.slack[at_band])
        # one-deletion neighbourhoods
        of = np.cumsum(new) - 1
        drop = wide[of] & (count[of] > 1)
        found_d.append(d[drop])
        found_s.append(core.mix64(total[of[drop]] - m[drop] + salt[of[drop]]))
        for x in np.flatnonzero(full).tolist():
            here = sd == x
            k = int(plan.exact[band[x]])
            single = ss[here & wide & (count == 1)]
            absent = np.setdiff1d(np.arange(k + int(plan.wide[band[x]])), ss[here])
            empty = np.concatenate((absent, single)).astype(core.U64)
            found_d.append(np.full(len(empty), x))
            found_s.append(core.mix64(core.mix64(core.U64(int(band[x])) * core.U64(1 << 32) + empty)))
    if not found_d:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=core.U64)
    return np.concatenate(found_d), np.concatenate(found_s)


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """did, size, node (hash of the set) of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = core.byte_list(batch.column(1))
            sizes, nodes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=core.U64)]
            for a, b in core.chunks(texts):
                size, node = fingerprints(*shingle_sets(texts[a:b], n), b - a)
                sizes.append(size)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes).astype(np.int64)), core.as_long(np.concatenate(nodes))], ["did", "size", "node"])

    return rows.select("did", "body").mapInArrow(scan, "did long, size long, node long")


def _signatures(rows: DataFrame, plan: Plan, n: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = core.byte_list(batch.column(0))
            for a, b in core.chunks(texts):
                doc, value = shingle_sets(texts[a:b], n)
                size, node = fingerprints(doc, value, b - a)
                d, sig = signatures(plan, doc, value, size)
                if len(d):
                    yield pa.RecordBatch.from_arrays([core.as_long(sig), core.as_long(node[d])], ["sig", "node"])

    return rows.select("body").mapInArrow(scan, "sig long, node long")


def _buckets(found: DataFrame) -> DataFrame:
    """sig, node, head (the smallest node of the signature) of signatures that two sets or more have; streams over sorted rows."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, bool] | None = None  # the last row, its head, and whether it has been given
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if last is not None:
                sig, node = np.concatenate(([last[0]], sig)), np.concatenate(([last[1]], node))
            keep = np.ones(len(sig), dtype=bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node = sig[keep], node[keep]
            like = sig[1:] == sig[:-1]
            out = np.zeros(len(sig), dtype=bool)
            out[1:] |= like
            out[:-1] |= like
            start = np.flatnonzero(np.concatenate(([True], ~like)))
            head = np.repeat(node[start], np.diff(np.append(start, len(sig))))
            if last is not None:
                head[: start[1] if len(start) > 1 else len(sig)] = last[2]
                given, out[0] = last[3], out[0] and not last[3]
            else:
                given = False
            last = int(sig[-1]), int(node[-1]), int(head[-1]), bool(out[-1]) or (given and len(sig) == 1)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(node[out]), pa.array(head[out])], ["sig", "node", "head"])

    return found.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(stream, "sig long, node long, head long")


#: Bits of the filter that keeps documents without a shared signature out of an exchange: 4 MB at any size of input.
#: When most bits are set it lets most documents pass, and the exact join behind it does the work.
FILTER_BITS = 1 << 25


def sketches(doc: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> list[bytes]:
    """A bit for each of 2 to 4 bins per element: the parity of the elements hashed there.

    Two sketches differ in at most as many bits as the sets differ in elements, also after halves are folded together.
    """
    out = []
    low, high = np.searchsorted(doc, wanted), np.searchsorted(doc, wanted, "right")
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        bins = max(64, 1 << (2 * (b - a) - 1).bit_length())
        bits = np.bincount((value[a:b] & core.U64(bins - 1)).astype(np.int64), minlength=bins) & 1
        out.append(np.packbits(bits.astype(np.uint8), bitorder="little").tobytes())
    return out


def _folded(sketch: np.ndarray, n: int) -> np.ndarray:
    while sketch.shape[1] > n:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def _near_pairs(one: list, two: list | None, num: int, den: int, nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different components whose sketches allow a link; nearest: only the nearest of each member.

    one, two: node, component, home, size, sketch of two blocks (two None: of one block with itself); members of one home are
    no pair, homes may be None.
    """
    found_a, found_b, found_d = [], [], []
    same = two is None
    two = one if same else two

    def by_bins(block: list) -> dict[int, tuple[np.ndarray, ...]]:
        node, component, home, size, sketch = block
        of: dict[int, list[int]] = {}
        for i, s in enumerate(sketch):
            of.setdefault(len(s), []).append(i)
        return {n: (np.array(node)[i], np.array(component)[i], None if home[0] is None else np.array(home)[i], np.array(size)[i], np.frombuffer(b"".join(sketch[j] for j in i), dtype=core.U64).reshape(len(i), n // 8)) for n, i in of.items()}

    left, right = by_bins(one), by_bins(two)
    for n1, (na, ca, ha, sa, ka) in left.items():
        for n2, (nb, cb, hb, sb, kb) in right.items():
            if (n1 > n2 and same) or max(n1, n2) > 2 * min(n1, n2):
                continue
            bins = min(n1, n2) // 8
            x, y = _folded(ka, bins), _folded(kb, bins)
            for i in range(len(na)):
                total = sa[i] + sb
                most = total - 2 * -(-num * total // (num + den))
                ok = (ca[i] != cb) & (den * np.minimum(sa[i], sb) >= num * np.maximum(sa[i], sb))
                if ha is not None:
                    ok &= ha[i] != hb
                if same and n1 == n2:
                    ok[: i + 1] = False
                some = np.flatnonzero(ok)
                d = np.bitwise_count(x[i] ^ y[some]).sum(axis=1, dtype=np.int64)
                fits = d <= most[some]
                found_a.append(np.full(int(fits.sum()), na[i]))
                found_b.append(nb[some][fits])
                found_d.append(d[fits])
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b, d = np.concatenate(found_a), np.concatenate(found_b), np.concatenate(found_d)
    if nearest and len(a):
        keep = np.zeros(len(a), dtype=bool)
        for end in (a, b):
            by = np.lexsort((d, end))
            keep[by[np.concatenate(([True], end[by][1:] != end[by][:-1]))]] = True
        a, b = a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


def _filter(nodes: DataFrame) -> np.ndarray:
    placed = nodes.select((F.col("node").bitwiseAND(F.lit(FILTER_BITS - 1))).alias("place"))
    words = placed.groupBy(F.expr("shiftright(place, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 31L as int)))").alias("bits"))
    out = np.zeros(FILTER_BITS >> 5, dtype=np.uint32)
    found = words.toPandas()
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _chosen(rows: DataFrame, nodes: DataFrame, n: int, sketched: bool) -> DataFrame:
    """node, size, sketch (sketched) or node, body of one text of each of the given sets."""
    shared = rows.sparkSession.sparkContext.broadcast(_filter(nodes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            texts = core.byte_list(batch.column(0))
            for a, b in core.chunks(texts):
                doc, value = shingle_sets(texts[a:b], n)
                size, node = fingerprints(doc, value, b - a)
                place = (node & core.U64(FILTER_BITS - 1)).astype(np.int64)
                some = np.flatnonzero((bits[place >> 5] >> (place & 31).astype(np.uint32)) & np.uint32(1))
                if len(some) and sketched:
                    yield pa.RecordBatch.from_arrays([core.as_long(node[some]), pa.array(size[some]), pa.array(sketches(doc, value, some), type=pa.binary())], ["node", "size", "sketch"])
                elif len(some):
                    yield pa.RecordBatch.from_arrays([core.as_long(node[some]), pa.array([texts[a + i] for i in some.tolist()], type=pa.binary())], ["node", "body"])

    columns = {"size": "long", "sketch": "binary"} if sketched else {"body": "binary"}
    found = rows.select("body").mapInArrow(scan, ", ".join(["node long", *(f"{k} {v}" for k, v in columns.items())])).join(nodes, "node", "left_semi")
    return core.checkpointed(found.groupBy("node").agg(*(F.max(c).alias(c) for c in columns)))


def _linked(pairs: DataFrame, bodies: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose whole sets link."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a, first = None, np.zeros(0, dtype=core.U64)
        for batch in batches:
            a = batch.column(0).to_pylist()
            ok = np.zeros(len(a), dtype=bool)
            other = core.byte_list(batch.column(3))
            for x, y in core.chunks(other):
                doc, value = shingle_sets(other[x:y], n)
                edge = np.searchsorted(doc, np.arange(y - x + 1))
                for i in range(x, y):
                    if a[i] != last_a:
                        last_a, first = a[i], shingle_sets([batch.column(2)[i].as_py()], n)[1]
                    second = value[edge[i - x] : edge[i - x + 1]]
                    if den * min(len(first), len(second)) < num * max(len(first), len(second)):
                        continue
                    both = np.concatenate((first, second))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    ok[i] = den * shared >= num * (len(both) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    joined = pairs.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b").join(bodies.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Documents with the component of the documents they reach by links of Jaccard >= num / den.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), one row per row of docs.
    Words are lower-cased (A-Z) runs of anything but ASCII white space, sets are the distinct n-grams of words, and the
    whole sequence where there are fewer words.  Null and empty texts have no set and link with nothing; documents with
    equal sets link; rows that share a doc_id each link by their own sets; a null doc_id sorts before all others, and what
    reaches one has component_id null; an empty table gives no rows; other columns are not read.
    """
    rows = repeats.prepared(docs, id_col, text_col)
    sets = core.checkpointed(_sets(rows, n))
    plan = Plan({r[0]: r[1] for r in sets.filter("size > 0").groupBy((F.floor(F.pow(F.lit(1.02), F.floor(F.log(F.col("size")) / math.log(1.02)))).cast("long")).alias("s")).agg(F.count("*")).collect()} | {r[0]: 0 for r in sets.agg(F.max("size")).collect() if r[0]}, num, den)
    buckets = core.checkpointed(_buckets(_signatures(rows, plan, n)))
    classes = sets.filter("size > 0").groupBy("node").agg(F.min("did").alias("did"))

    # the classes that share a signature with another: sketches first, texts only of what the sketches leave
    shared = core.checkpointed(buckets.select("node").distinct())
    held = _chosen(rows, shared, n, sketched=True)
    groups = core.checkpointed(_groups(buckets))
    done = component = None
    for kind in ("heads", "nearest", "home", "rest"):
        if kind == "heads":
            pairs = _alike(buckets.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), held, num, den)
        else:
            if kind == "nearest":
                groups = core.checkpointed(_homes(groups))
            left = core.checkpointed(_unsettled(groups, component, kind != "rest"))
            if left.isEmpty():
                continue
            pairs = _across(left, held, num, den, kind == "nearest").join(done, ["a", "b"], "left_anti")
        pairs = core.checkpointed(pairs)
        ends = core.checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        if component is not None and ends.isEmpty():
            continue  # the nearest may all have been compared before
        fresh = _linked(pairs, _chosen(rows, ends, n, sketched=False), n, num, den)
        done = pairs if done is None else done.unionByName(pairs)
        # what was contracted before is a star of each component
        component = connected_components(fresh if component is None else fresh.unionByName(component.select(F.col("component").alias("a"), F.col("node").alias("b"))), alone=ALONE)
    named = classes.join(component, "node", "left").withColumn("component", F.coalesce("component", F.col("node")))
    smallest = named.groupBy("component").agg(F.min("did").alias("root"))
    rooted = named.join(smallest, "component").select("node", "root")
    out = sets.join(rooted, "node", "left")
    return out.select(F.when(F.col("did") != repeats.NO_ID, F.col("did")).alias("doc_id"), F.col("size").alias("n_shingles"), F.nullif(F.coalesce("root", F.col("did")), F.lit(repeats.NO_ID)).alias("component_id"))


#: Members of a block of a group that is compared with another in one go.
BLOCK = 4096
#: Edges that one task turns into components.
ALONE = 200_000


def _alike(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (batch.column(i).to_numpy() for i in (2, 3))
            total = sa + sb
            most = total - 2 * -(-num * total // (num + den))
            ok = den * np.minimum(sa, sb) >= num * np.maximum(sa, sb)
            for i in np.flatnonzero(ok).tolist():
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), dtype=core.U64)[None] for c in (4, 5))
                m = min(x.shape[1], y.shape[1])
                ok[i] = np.bitwise_count(_folded(x, m) ^ _folded(y, m)).sum(dtype=np.int64) <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    one, two = (held.select(F.col("node").alias(x), F.col("size").alias(f"s{x}"), F.col("sketch").alias(f"k{x}")) for x in ("a", "b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb", "ka", "kb").mapInArrow(keep, "a long, b long")


def _groups(buckets: DataFrame) -> DataFrame:
    """grp, node: the members of each bucket but its head, which meets them all; buckets of the same members are one group.

    A group is named by a hash of its members.  Groups that this hash took together would only be compared with each other.
    """
    same = Window.partitionBy("sig")
    rest = buckets.filter("node <> head").select("node", F.count("*").over(same).alias("many"), F.expr("bit_xor(xxhash64(node))").over(same).alias("all"))
    return rest.filter("many > 1").select(F.xxhash64("all", "many").alias("grp"), "node").distinct()


def _homes(groups: DataFrame) -> DataFrame:
    """grp, node, home: the largest of the node's groups."""
    sized = groups.withColumn("many", F.count("*").over(Window.partitionBy("grp")))
    return sized.withColumn("home", F.first("grp").over(Window.partitionBy("node").orderBy(F.desc("many"), "grp"))).select("grp", "node", "home")


def _unsettled(groups: DataFrame, component: DataFrame, at_home: bool) -> DataFrame:
    """grp, node, component, home, and the number of rows of each group that holds several components.

    at_home: of members in their homes only.  Otherwise the groups that hold several homes too: members of one home have met there.
    """
    named = (groups.filter("grp = home") if at_home else groups).join(component, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("component"), "home")
    columns = ["component"] if at_home else ["component", "home"]
    same = Window.partitionBy("grp")
    spread = named.select("*", *(f(c).over(same).alias(f"{c}{i}") for c in columns for i, f in enumerate((F.min, F.max))), F.count("*").over(same).alias("many"))
    return spread.filter(" and ".join(f"{c}0 <> {c}1" for c in columns)).select("grp", "node", "component", F.when(F.lit(not at_home), F.col("home")).alias("home"), "many")


def _across(groups: DataFrame, held: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Distinct pairs a < b of different components, and of different homes where they are given, that share a group and whose sketches allow a link.

    A group of more than a block of members is dealt into blocks, and each pair of blocks meets in a task of its own.
    """
    blocks = F.ceil(F.col("many") / F.lit(BLOCK)).cast("long")
    placed = groups.withColumn("block", F.when(F.col("many") > BLOCK, F.pmod(F.xxhash64("node"), blocks)).otherwise(F.lit(0)))
    whole = placed.filter(F.col("many") <= BLOCK).withColumn("other", F.lit(0).cast("long"))
    parts = placed.filter(F.col("many") > BLOCK).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = whole.unionByName(parts).select("grp", F.least("block", "other").alias("c1"), F.greatest("block", "other").alias("c2"), (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "component", "home")
    dealt = met.join(held.select("node", "size", "sketch"), "node").select("grp", "c1", "c2", "side", "node", "component", "home", "size", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, [[[], [], [], [], []], [[], [], [], [], []]]
        out: list = [[], []]

        def close() -> None:
            if key is not None:
                a, b = _near_pairs(sides[0], None if key[1] == key[2] else sides[1], num, den, nearest)
                out[0].append(a)
                out[1].append(b)

        for batch in batches:
            for grp, c1, c2, side, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, c1, c2) != key:
                    close()
                    key, sides = (grp, c1, c2), [[[], [], [], [], []], [[], [], [], [], []]]
                for column, value in zip(sides[side], row, strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])
                out = [[], []]
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["a", "b"])

    dealt = dealt.repartition("grp", "c1", "c2").sortWithinPartitions("grp", "c1", "c2", "side")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def brute_force(texts: dict[int, str | None], n: int = 4, num: int = 85, den: int = 100) -> dict[int, tuple[int, int]]:
    """The same over all pairs (small inputs)."""
    import re

    sets = {}
    for did, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[did] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(d for d in texts if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if den * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in texts}
