"""Byte-level substring dedup from merged Burrows-Wheeler transforms (operator 1).

The pieces of text that could hold a repeated run of L bytes (``repeats``) are
dealt by key into buckets and by document into the shards of a bucket.  A task builds
the transform of a shard and hands it on; another task merges the transforms of a
bucket by iterative interleave refinement: step by step, the entries that share the
first h symbols are split by the two symbols that precede them, following the
shards' LF mappings, until h = L.  Blocks that still hold several entries are the
repeated intervals (common prefix of L at least); the merging task has neither the
texts nor the suffix arrays, and no suffix is sorted again.  A piece stands for its
byte-identical copies, which are removed from the second on: as entries of one string
they could never part.

Only entries that end a window are refined (an entry reaches a window start after
exactly L symbols), and an entry alone in its block leaves at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, repeats

#: Bytes of pieces whose shards are merged together.
BUCKET_BYTES = 1 << 20
SHARDS = 4
#: Symbols that suffixes are first sorted by.
WORD = 5


def shard_transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of a text of sentinel-ended strings (0 ends a string), by rank doubling from 5-byte words.

    Sentinels compare by their position, so every suffix is distinct and sorting stops at the end of a string.  The rank of a
    suffix is the place where its group starts, so a round moves only what is still tied.
    """
    n = len(text)
    bits = max(1, n.bit_length())
    padded = np.concatenate((text, np.zeros(WORD, dtype=np.uint8)))
    word, ended = np.zeros(n, dtype=core.U64), np.zeros(n, dtype=bool)
    for i in range(WORD):  # nothing after a sentinel counts
        word <<= core.U64(8)
        symbol = padded[i : i + n]
        word |= np.where(ended, np.uint8(0), symbol)
        ended |= symbol == 0
    w, order = sorted_by(word, 8 * WORD, n)  # ended suffixes with equal words: by their sentinels
    new = ended[order]
    new[:1] = True
    new[1:] |= w[1:] != w[:-1]
    position = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, position, 0))
    tied = order[~alone(new)]
    h = WORD
    while len(tied):
        key = (rank[tied].astype(core.U64) << core.U64(bits)) | rank[np.minimum(tied + h, n - 1)].astype(core.U64)
        key, by = sorted_by(key, 2 * bits, len(tied))
        tied = tied[by]
        old = (key >> core.U64(bits)).astype(np.int64)
        # new rank: start of the old group plus the number of smaller keys in it
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        head = np.ones(len(tied), dtype=bool)
        head[1:] = old[1:] != old[:-1]
        place = position[: len(tied)]
        base = np.maximum.accumulate(np.where(head, place, 0))
        lead = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[tied] = old + (lead - base)
        tied = tied[~alone(fresh)]
        h *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = position
    return sa, text[sa - 1]


def sorted_by(key: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, stable order) of n keys of so many bits; key and place are sorted as one number where 64 bits hold both."""
    low = max(1, n.bit_length())
    if bits + low > 64:
        by = np.argsort(key, kind="stable")
        return key[by], by
    both = np.sort((key << core.U64(low)) | np.arange(n, dtype=core.U64))
    return both >> core.U64(low), (both & core.U64((1 << low) - 1)).astype(np.int64)


def alone(new: np.ndarray) -> np.ndarray:
    """Which places are a group of their own; new: where groups start."""
    out = new.copy()
    out[:-1] &= new[1:]
    return out


def lf_mapping(transform: np.ndarray) -> np.ndarray:
    """LF of each row: the row of the suffix that is one symbol longer.

    Sentinels of the transform map to no row of use (their entries are dropped), so ties among them do not matter.
    """
    lf = np.empty(len(transform), dtype=np.int32)
    lf[np.argsort(transform, kind="stable")] = np.arange(len(transform), dtype=np.int32)
    return lf


class Shard:
    """The transform of some pieces, the rows where a window ends, and the window of each, numbered through the pieces."""

    def __init__(self, texts: list[bytes], length: int):
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        text = np.frombuffer(b"\xff".join(texts) + b"\xff", dtype=np.uint8) + np.uint8(1)  # UTF-8 has no 0xFF: sentinel 0, symbols 1 to 255
        inside = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
        sa, self.transform = shard_transform(text)
        ends = inside[sa] >= length
        self.rows = np.flatnonzero(ends).astype(np.int32)
        n = np.maximum(size - length, 0)
        first = np.cumsum(n) - n - (np.cumsum(size) - size)  # of a piece's windows, less that of its symbols
        self.window = (np.repeat(first, size)[sa[ends]] + sa[ends] - length).astype(np.int32)


def merged_intervals(shards: list[Shard], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Merges the shards' transforms and returns the repeated intervals of depth length.

    Returns (window, block) of all windows in blocks of two or more; windows are numbered through the shards in the order of
    their rows.
    """
    lfs, entries, base = [], [], 0
    for shard in shards:
        lfs.append(lf_mapping(shard.transform) + np.int32(base))
        entries.append(shard.rows + np.int32(base))
        base += len(shard.transform)
    transform, lf = np.concatenate([s.transform for s in shards]), np.concatenate(lfs)
    active = np.concatenate(entries).astype(np.int32)
    window = np.arange(len(active), dtype=np.int32)
    block = np.zeros(len(active), dtype=np.int32)

    def refine(key: np.ndarray, target: np.ndarray, dead: np.ndarray) -> None:
        nonlocal active, window, block
        alive = ~dead[active]
        if not alive.all():
            active, window, block = active[alive], window[alive], block[alive]
        own = key[active]
        by = np.argsort(own, kind="stable")
        own, block, window, active = own[by], block[by], window[by], target[active[by]]
        edge = np.ones(len(own) + 1, dtype=bool)
        if len(own):
            edge[1:-1] = (own[1:] != own[:-1]) | (block[1:] != block[:-1])
        keep = ~(edge[:-1] & edge[1:])
        block = np.cumsum(edge[:-1], dtype=np.int32)[keep]
        active, window = active[keep], window[keep]

    depth = 0
    if length % 2:
        refine(transform, lf, transform == 0)
        depth = 1
    pair = (transform[lf].astype(np.uint16) << np.uint16(8)) | transform
    dead = (pair & np.uint16(255) == 0) | (pair >> np.uint16(8) == 0)
    lf = lf[lf]
    while depth < length and len(active):
        refine(pair, lf, dead)
        depth += 2
    return window, block


def later_runs(shards: list[Shard], pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """did, tie, loc of the runs of windows that also start earlier; pieces: did, tie and loc of each shard's pieces."""
    window, block = merged_intervals(shards, length)
    none = np.zeros(0, dtype=np.int64)
    if not len(window):
        return none, none, none
    did, tie, loc = (np.concatenate(x) for x in zip(*pieces, strict=True))
    n = loc & repeats.LOW
    of_shard = np.concatenate(([0], np.cumsum([len(s.window) for s in shards])))[:-1]
    number = np.concatenate([s.window.astype(np.int64) + f for s, f in zip(shards, of_shard.tolist(), strict=True)])[window]
    piece = np.searchsorted(np.cumsum(n), number, "right")
    start = (loc >> repeats.SHIFT)[piece] + number - (np.cumsum(n) - n)[piece]
    order = np.lexsort((loc, tie, did))
    rank = np.empty(len(did), dtype=np.int64)
    rank[order] = np.arange(len(did))
    by = np.lexsort((start, tie[piece], did[piece], block))
    block, piece, start = block[by], piece[by], start[by]
    later = np.zeros(len(by), dtype=bool)
    later[1:] = block[1:] == block[:-1]
    piece, start = piece[later], start[later]
    by = np.lexsort((start, rank[piece]))
    piece, start = piece[by], start[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (piece[1:] != piece[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(by)) - 1
    lo = start[at]
    return did[piece[at]], tie[piece[at]], (lo << repeats.SHIFT) | (start[last] - lo + 1)


SHARD = "bucket int, shard int, dids array<long>, ties array<int>, locs array<long>, transform binary, ends binary, windows binary"


def shard_transforms(opened: DataFrame, buckets: int, length: int) -> DataFrame:
    """One row per bucket and shard: its pieces, transform and windows.  opened: h, did, tie, loc, piece."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple[int, int] | None = None
        held: list[list] = [[], [], [], []]

        def close() -> pa.RecordBatch:
            s = Shard(held[3], length)
            ends = np.zeros(len(s.transform), dtype=np.uint8)
            ends[s.rows] = 1
            raw = [x.tobytes() for x in (s.transform, np.packbits(ends), s.window)]
            columns = [[key[0]], [key[1]], *([x] for x in held[:3]), *([x] for x in raw)]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.binary()] * 3)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "shard", "dids", "ties", "locs", "transform", "ends", "windows"])

        for batch in batches:
            for bucket, shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (bucket, shard):
                    if key is not None:
                        yield close()
                    key, held = (bucket, shard), [[], [], [], []]
                for column, value in zip(held, row, strict=True):
                    column.append(value)
        if key is not None:
            yield close()

    dealt = opened.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64("did", "tie"), F.lit(SHARDS)).cast("int").alias("shard"), "did", "tie", "loc", "piece")
    return dealt.repartition("bucket", "shard").sortWithinPartitions("bucket", "shard").mapInArrow(build, SHARD)


def merge_shards(shards: DataFrame, length: int) -> DataFrame:
    """did, tie, loc of the runs of windows that also start earlier, from the shards of each bucket."""

    def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: int | None = None
        held: list[Shard] = []
        pieces: list[tuple] = []

        def close() -> pa.RecordBatch:
            did, tie, loc = later_runs(held, pieces, length)
            return pa.RecordBatch.from_arrays([pa.array(did.astype(np.int64)), pa.array(tie.astype(np.int32)), pa.array(loc.astype(np.int64))], ["did", "tie", "loc"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column(0)[0].as_py() != bucket:
                    if held:
                        yield close()
                    bucket, held, pieces = row.column(0)[0].as_py(), [], []
                pieces.append(tuple(row.column(k).flatten().to_numpy() for k in (2, 3, 4)))
                shard = Shard.__new__(Shard)
                shard.transform, ends, shard.window = (np.frombuffer(row.column(k)[0].as_buffer(), dtype=t) for k, t in ((5, np.uint8), (6, np.uint8), (7, np.int32)))
                shard.rows = np.flatnonzero(np.unpackbits(ends, count=len(shard.transform))).astype(np.int32)
                held.append(shard)
        if held:
            yield close()

    return shards.repartition("bucket").sortWithinPartitions("bucket", "shard").mapInArrow(merging, "did long, tie int, loc long")


def cut_bytes(length: int):
    return lambda text, wanted: [text[lo : lo + n - 1 + length] for lo, n in wanted]


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, anchor: int = 32) -> DataFrame:
    """Cuts every byte covered by a run of ``length`` bytes that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary, the remaining bytes).
    Earlier: smaller doc_id, or the same document and an earlier start.  Texts under ``length`` bytes and null or
    empty texts keep all they have; an empty table gives no rows; other columns are not read.  See ``repeats`` for
    null ids and repeated rows.
    """
    anchor = min(anchor, length)
    rows = repeats.prepared(docs, id_col, text_col)
    settled = core.checkpointed(repeats.settle(repeats.pieces(rows, repeats.byte_symbols, length, anchor), across_documents=False))

    opened = settled.filter("open")
    size = opened.agg(F.sum(F.col("loc").bitwiseAND(F.lit(repeats.LOW)) + F.lit(length))).first()[0] or 0
    merged = merge_shards(shard_transforms(repeats.open_texts(rows, settled, cut_bytes(length)), -(-size // BUCKET_BYTES) or 1, length), length)
    spans = settled.filter("not open").select("did", "tie", "loc").unionByName(merged)

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for text, locs in zip(core.byte_list(batch.column(2)), batch.column(4).to_pylist(), strict=True):
                mask = repeats.covered(len(text), locs, length)
                sizes.append(len(text))
                removed.append(int(mask.sum()))
                runs.append(int((np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1).sum()))
                kept.append(np.frombuffer(text, dtype=np.uint8)[~mask].tobytes() if locs else text)
            did = pa.array([x if named else None for x, named in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([did, pa.array(sizes, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(runs, type=pa.int64()), pa.array(kept, type=pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats.with_spans(rows, spans).mapInArrow(cutting, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def brute_force(texts: dict[int, bytes], length: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """The same by looking every window up (small inputs)."""
    seen: set[bytes] = set()
    out = {}
    for did in sorted(texts):
        t = texts[did]
        mask = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                mask[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(mask.view(np.int8), prepend=np.int8(0)) == 1).sum())
        kept = np.frombuffer(t, dtype=np.uint8)[~mask].tobytes()
        out[did] = (len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out
