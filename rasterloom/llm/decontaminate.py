"""Benchmark decontamination by a prefix-filtered set join (operator 7).

Every benchmark item is cut into windows of W consecutive words (a shorter item is
one window).  A window is a set of shingles of five words; containment is exact, so
all its shingles must occur, its necessary prefix is one shingle, and the rarest one
over all documents (counted in a first pass) is taken.  The second pass joins the
shingles of each document with those prefixes, drops hits whose window would pass
either end of the document (positional and length bounds), and verifies the rest on
the words of the whole window.

The benchmark is the stated query set: its windows are held by every task, so they
are read in blocks of a checked size, and documents are scanned once per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

#: Bytes of item text whose windows one scan of the documents looks for.
BLOCK_BYTES = 8 << 20


def words_of(texts: list[bytes]) -> core.Words:
    return core.Words(texts, core.LETTER_WORDS, core.LOWER)


class Windows:
    """Windows of a block of items, their prefix shingles and what is needed to verify a hit."""

    def __init__(self, items: list[tuple[str, bytes]], window: int, shingle: int):
        words = words_of([t for _, t in items])
        counts = words.counts
        self.ids = [i for i, _ in items]
        self.words = words.hash
        start, size, item = [], [], []
        for d in np.flatnonzero(counts):
            n = min(int(counts[d]), window)
            s = np.arange(words.first[d], words.first[d + 1] - n + 1)
            start.append(s)
            size.append(np.full(len(s), n))
            item.append(np.full(len(s), d))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        self.start, self.size, self.item = cat(start), cat(size), cat(item)
        self.shingle = np.minimum(self.size, shingle)
        #: Distinct (length, hash) of all shingles, by length.
        self.vocabulary: dict[int, np.ndarray] = {}
        self.rolled: dict[int, np.ndarray] = {}
        for k in np.unique(self.shingle).tolist():
            self.rolled[k] = core.rolling(self.words, k)
            mine = self.shingle == k
            per = (self.size - k + 1)[mine]
            at = np.repeat(self.start[mine], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            self.vocabulary[k] = np.unique(self.rolled[k][at])

    def choose(self, counts: dict[tuple[int, int], int]) -> None:
        """Takes the rarest shingle of each window (ties: the first) as its prefix."""
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, vocabulary in self.vocabulary.items():
            frequency = np.array([counts.get((k, i), 0) for i in range(len(vocabulary))], dtype=np.int64)
            mine = np.flatnonzero(self.shingle == k)
            best = np.zeros(len(mine), dtype=np.int64)
            least = np.full(len(mine), np.iinfo(np.int64).max)
            for offset in range(int((self.size[mine] - k + 1).max())):
                has = offset < self.size[mine] - k + 1
                at = np.searchsorted(vocabulary, self.rolled[k][self.start[mine[has]] + offset])
                f = np.full(len(mine), np.iinfo(np.int64).max)
                f[has] = frequency[at]
                better = f < least
                best[better], least[better] = offset, f[better]
            token = self.rolled[k][self.start[mine] + best]
            by = np.argsort(token, kind="stable")
            distinct, first, n = np.unique(token[by], return_index=True, return_counts=True)
            self.prefix[k] = (distinct, first, n, np.stack([mine[by], best[by]]))

    def hits(self, words: core.Words) -> tuple[np.ndarray, np.ndarray]:
        """(window, first word) of every occurrence in a chunk of documents."""
        found_w, found_s = [], []
        for k, (distinct, first, n, windows) in self.prefix.items():
            place, which = lookup(core.rolling(words.hash, k), distinct)
            if not len(place):
                continue
            per = n[which]
            at = np.repeat(first[which], per) + (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
            w, offset = windows[0][at], windows[1][at]
            place = np.repeat(place, per)
            doc = words.doc[place]
            s = place - offset
            ok = (s >= words.first[doc]) & (s + self.size[w] <= words.first[doc + 1])
            w, s = w[ok], s[ok]
            same = np.ones(len(w), dtype=bool)
            for j in range(int(self.size.max())):
                inside = same & (j < self.size[w])
                same[inside] = words.hash[s[inside] + j] == self.words[self.start[w[inside]] + j]
            found_w.append(w[same])
            found_s.append(s[same])
        if not found_w:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(found_w), np.concatenate(found_s)


def lookup(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values found in the sorted table, and where; a small bit table first."""
    if not len(table) or not len(values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    marks = np.zeros(1 << 20, dtype=bool)
    marks[(table >> core.U64(44)).astype(np.int64)] = True
    place = np.flatnonzero(marks[(values >> core.U64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[place]), len(table) - 1)
    same = table[at] == values[place]
    return place[same], at[same]


def _blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    size = items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0
    n = -(-size // limit)
    if n <= 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(n)) == i) for i in range(n)]


def _windows(docs: DataFrame, block: DataFrame, window: int, shingle: int) -> Windows:
    """The windows of a block, prefixes chosen by shingle counts over all documents."""
    windows = Windows([(r[0], r[1].encode()) for r in block.collect()], window, shingle)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {k: np.zeros(len(v), dtype=np.int64) for k, v in windows.vocabulary.items()}
        for batch in batches:
            texts = core.byte_list(batch.column(0))
            for a, b in core.chunks(texts):
                words = words_of(texts[a:b])
                for k, total in totals.items():
                    total += np.bincount(lookup(core.rolling(words.hash, k), windows.vocabulary[k])[1], minlength=len(total))
        for k, total in totals.items():
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(some), pa.array(total[some])], ["k", "i", "n"])

    counted = docs.select("body").mapInArrow(counting, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    windows.choose({(r[0], r[1]): r[2] for r in counted.collect()})  # as many rows as the block has shingles at most
    return windows


RESULT = "n_words long, n_hit long, items array<string>"


def benchmark_decontamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shingle: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Marks the words of documents that stand inside a window of a benchmark item.

    Returns did (the document's id), tie, body and n_words, n_hit, items (ids as strings, sorted), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words), one row per row of docs.  Words are lower-cased runs of ASCII letters, digits
    and non-ASCII characters.  Null and empty texts have no words and hit nothing; items without words and items with a
    null id are left out; an item given twice counts once; empty tables give no rows, or no hits; other columns are not
    read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("did"), F.xxhash64(text).alias("tie"), text.alias("body"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("item_text")).dropna().distinct()
    blocks = _blocks(items, block_bytes)
    if len(blocks) == 1:
        out = _scan(rows, _windows(rows, items, window, shingle))
    else:
        spans = None
        for block in blocks:
            one = _scan(rows, _windows(rows, block, window, shingle), spans=True)
            spans = one if spans is None else spans.unionByName(one)
        out = _unite(rows, spans)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _scan(rows: DataFrame, windows: Windows, spans: bool = False) -> DataFrame:
    """Documents with their hits; spans: instead, for documents with hits, did, tie, items and the hit words' runs."""
    ids = np.array(windows.ids, dtype=object)

    def scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = core.byte_list(batch.column(2))
            total, hit, items, runs = [], [], [], []
            for a, b in core.chunks(texts):
                words = words_of(texts[a:b])
                w, s = windows.hits(words)
                depth = np.zeros(len(words.hash) + 1, dtype=np.int32)
                np.add.at(depth, s, 1)
                np.add.at(depth, s + windows.size[w], -1)
                inside = np.cumsum(depth[:-1]) > 0
                total.append(words.counts)
                hit.append(np.bincount(words.doc[inside], minlength=b - a))
                mine: list[set[str]] = [set() for _ in range(b - a)]
                pairs = np.unique(np.stack([words.doc[s], windows.item[w]]), axis=1) if len(s) else np.zeros((2, 0), dtype=np.int64)
                for d, i in pairs.T.tolist():
                    mine[d].add(ids[i])
                items += [sorted(x) for x in mine]
                if spans:
                    masks = np.flatnonzero(inside)
                    where: list[list[int]] = [[] for _ in range(b - a)]
                    for d, p in zip(words.doc[masks].tolist(), (masks - words.first[words.doc[masks]]).tolist(), strict=True):
                        where[d].append(p)
                    runs += where
            cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
            if spans:
                some = [i for i, x in enumerate(items) if x]
                keys = batch.select(["did", "tie"]).take(pa.array(some, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([*keys.columns, pa.array([items[i] for i in some], type=pa.list_(pa.string())), pa.array([runs[i] for i in some], type=pa.list_(pa.int64()))], ["did", "tie", "items", "places"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cat(total)), pa.array(cat(hit)), pa.array(items, type=pa.list_(pa.string()))], [*batch.schema.names, "n_words", "n_hit", "items"])

    kind = rows.schema["did"].dataType.simpleString()
    return rows.mapInArrow(scanning, f"did {kind}, tie long, items array<string>, places array<long>" if spans else f"did {kind}, tie long, body string, {RESULT}")


def _unite(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document from the hits of several blocks."""
    merged = spans.groupBy("did", "tie").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"))
    counted = rows.alias("r").join(merged.alias("m"), F.col("r.did").eqNullSafe(F.col("m.did")) & (F.col("r.tie") == F.col("m.tie")), "left")
    words = F.regexp_count("r.body", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    return counted.select("r.did", "r.tie", "r.body", words.alias("n_words"), F.coalesce("m.n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("m.items", F.array().cast("array<string>")).alias("items"))


def brute_force(texts: dict[int, str], items: dict[int, str], window: int = 13) -> dict[int, tuple]:
    """The same window by window (small inputs)."""
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wanted: dict[tuple, set[str]] = {}
    for i, t in items.items():
        ws = split(t)
        n = min(window, len(ws))
        for s in range(len(ws) - n + 1 if n else 0):
            wanted.setdefault(tuple(ws[s : s + n]), set()).add(str(i))
    sizes = {len(x) for x in wanted}
    out = {}
    for did, t in texts.items():
        ws, hit, mine = split(t), set(), set()
        for n in sizes:
            for s in range(len(ws) - n + 1):
                if (w := tuple(ws[s : s + n])) in wanted:
                    hit |= set(range(s, s + n))
                    mine |= wanted[w]
        out[did] = (len(ws), len(hit), len(mine), hashlib.sha256(",".join(sorted(mine)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))
    return out
