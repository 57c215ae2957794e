"""Where the same run of L symbols (bytes or words) stands more than once.

Shared front and back of the two substring operators.  Every run of L symbols (a
window) is keyed by the smallest hash of the k-symbol strings inside it, so equal
windows have equal keys wherever they stand.  Consecutive windows of one document
with the same key form a *piece*, stored as a few numbers.  Sorting the pieces by
(key, content hash, document, start) in one exchange and streaming over them
leaves out every key that occurs once, leads every other copy of a content to its first
piece, and names the pieces whose windows have to be compared.

Rows equal in doc_id and text count as one document (each row is returned, with
the same result).  Rows that share a doc_id with different texts are ordered by
the CRC-32 of their text.  A null doc_id sorts before all others, a null text is
empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

SHIFT = 31
LOW = (1 << SHIFT) - 1
NO_ID = -(1 << 63)


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """did (null as the smallest long), tie, body, named (whether there is an id)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), (F.crc32(text) - F.lit(1 << 31)).cast("int").alias("tie"), text.alias("body"), F.col(id_col).isNotNull().alias("named"))


#: Bits for a position beside the 40 bits of a hash that order k-symbol strings; longer texts are cut into overlapping slices.
PLACE_BITS = 24
SLICE = 1 << 22


def piece_runs(symbols: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Key, content hash, document ordinal, first and last window start (in the document) of each piece, and whether a
    window of it could stand in it twice."""
    if len(symbols) > SLICE + length:
        parts = []
        for a in range(0, len(symbols) - length + 1, SLICE):
            b = min(a + SLICE + length - 1, len(symbols))
            cut = np.unique(np.concatenate(([a], first[(first > a) & (first < b)], [b])))
            key, content, d, lo, hi, own = piece_runs(symbols[a:b], cut - a, length, k)
            start = cut[d]
            owner = np.searchsorted(first, start, "right") - 1
            shift = start - first[owner]
            parts.append((key, content, owner, lo + shift, hi + shift, own))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    none = np.zeros(0, dtype=np.int64)
    nothing = none.view(core.U64), none.view(core.U64), none, none, none, none.astype(bool)
    if len(symbols) < length:
        return nothing
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = core.mix64(core.rolling(symbols, k))
    mask = core.U64((1 << PLACE_BITS) - 1)
    low = core.sliding_min((grams & ~mask) | np.arange(len(grams), dtype=core.U64), length - k + 1)
    start = np.flatnonzero(doc[: len(low)] == doc[length - 1 :])
    if not len(start):
        return nothing
    place = (low[start] & mask).astype(np.int64)  # the leftmost smallest
    key, owner = grams[place], doc[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    whole = core.mix64(core.rolling(symbols, length))[start]
    content = core.mix64(np.add.reduceat(whole, at) + whole[at] * core.U64(3) + (last - at).astype(core.U64))
    d = owner[at]
    return key[at], content, d, start[at] - first[d], start[last] - first[d], place[at] != place[last]


def byte_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return core._BYTE_VALUES[np.frombuffer(b"".join(texts), dtype=np.uint8)], first


def word_symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    words = core.Words(texts, core.SPACE_WORDS, core.SAME)
    return words.hash, words.first


#: Bytes of documents whose windows are hashed at once: the arrays of 8 bytes a symbol stay in the cache.
PIECE_CHUNK = 1 << 18

PIECES = "h long, ch long, did long, tie int, loc long, own boolean"


def pieces(docs: DataFrame, symbols: Callable, length: int, k: int) -> DataFrame:
    """One row for each piece of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = core.byte_list(batch.column(2))
            for a, b in core.chunks(texts, PIECE_CHUNK):
                key, content, d, lo, hi, own = piece_runs(*symbols(texts[a:b]), length, k)
                if len(key):
                    yield pa.RecordBatch.from_arrays([core.as_long(key), core.as_long(content), pa.array(dids[a:b][d]), pa.array(ties[a:b][d]), pa.array((lo << SHIFT) | (hi - lo + 1)), pa.array(own)], ["h", "ch", "did", "tie", "loc", "own"])

    return docs.mapInArrow(scan, PIECES)


SETTLED = "h long, did long, tie int, loc long, open boolean, odid long, otie int, oloc long"


def settle(found: DataFrame, across_documents: bool) -> DataFrame:
    """Streams over the pieces of each key; the state is two rows, whatever the size of a group.

    Returns h, did, tie, loc, open, odid, otie, oloc: open=false rows are identical (by both hashes) to the earlier piece
    odid, otie, oloc, the first of their content; open=true rows are the first of their content under a key with several
    contents, or may repeat a window in themselves: their windows are to be compared.
    across_documents: only pieces of a document with a smaller doc_id count as earlier.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # h, ch, did, tie, loc of the first piece of the content before this batch
        before: tuple | None = None  # the row before this batch
        held: tuple | None = None  # the first piece of a key that has had one content so far and has not been opened
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            once = np.ones(batch.num_rows, dtype=bool)  # rows that repeat doc_id and text have equal pieces, side by side
            once[1:] = np.any([x[1:] != x[:-1] for x in columns[:5]], axis=0)
            once[0] = before is None or before != tuple(x[0] for x in columns[:5])
            before = tuple(x[-1] for x in columns[:5])
            if not once.any():
                continue
            h, ch, did, tie, loc, own = (x[once] for x in columns)
            new_h = np.ones(len(h), dtype=bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c = new_h.copy()
            new_c[1:] |= ch[1:] != ch[:-1]
            if last is not None and last[0] == h[0]:
                new_h[0], new_c[0] = False, last[1] != ch[0]
            rep = np.flatnonzero(new_c)
            group = np.cumsum(new_c) - 1

            def first(column: np.ndarray, k: int) -> np.ndarray:
                held_over = column[0] if last is None else last[k]  # noqa: B023
                return np.where(group >= 0, column[rep][np.maximum(group, 0)], held_over) if len(rep) else np.full(len(column), held_over)  # noqa: B023

            owner = first(did, 2), first(tie, 3), first(loc, 4)
            opened = new_c & ~new_h
            opened[rep[:-1][~new_h[rep[1:]]]] = True
            if not across_documents:
                opened |= new_c & own
            copies = ~new_c & (did > owner[0]) if across_documents else ~new_c
            out = [(h[copies], did[copies], tie[copies], loc[copies], np.zeros(int(copies.sum()), dtype=bool), *(x[copies] for x in owner))]
            out.append((h[opened], did[opened], tie[opened], loc[opened], np.ones(int(opened.sum()), dtype=bool), did[opened], tie[opened], loc[opened]))
            if len(rep):
                if held is not None and not new_h[rep[0]]:
                    out.append(tuple(np.array([x]) for x in (held[0], *held[2:], True, *held[2:])))
                at = rep[-1]
                last = tuple(x[at] for x in (h, ch, did, tie, loc))
                held = last if new_h[at] and not opened[at] else None
            out = [x for x in out if len(x[0])]
            if out:
                types = (np.int64, np.int64, np.int32, np.int64, bool, np.int64, np.int32, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["h", "did", "tie", "loc", "open", "odid", "otie", "oloc"])

    dealt = found.repartition("h").sortWithinPartitions("h", "ch", "did", "tie", "loc")
    return dealt.mapInArrow(stream, SETTLED)


def per_document(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """Rows of a document gathered in an array (as many as the document has pieces at most)."""
    item: Column = F.struct(*columns) if len(columns) > 1 else F.col(columns[0])
    return rows.groupBy("did", "tie").agg(F.collect_list(item).alias(name))


def open_texts(docs: DataFrame, settled: DataFrame, cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]) -> DataFrame:
    """h, did, tie, loc and the text of each open piece."""
    wanted = per_document(settled.filter("open"), "wanted", "h", "loc")

    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            texts = core.byte_list(batch.column(2))
            for i, (did, tie, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if last == (did, tie):  # a row that repeats doc_id and text
                    continue
                last = did, tie
                wanted = {(w["h"], w["loc"]) for w in wanted}
                for (h, loc), piece in zip(wanted, cut(texts[i], [(loc >> SHIFT, loc & LOW) for _, loc in wanted]), strict=True):
                    for column, value in zip(out, (h, did, tie, loc, piece), strict=True):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, TEXT_TYPES, strict=True)], TEXT_NAMES)
                    out = ([], [], [], [], [])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, TEXT_TYPES, strict=True)], TEXT_NAMES)

    joined = docs.select("did", "tie", "body").repartition("did", "tie").join(wanted, ["did", "tie"]).select("did", "tie", "body", "wanted").sortWithinPartitions("did", "tie")
    return joined.mapInArrow(cutting, "h long, did long, tie int, loc long, piece binary")


#: Bytes of documents whose passages are held at once.
PART_BYTES = 2 << 20


def part_of(did: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(did, F.lit(3)), F.lit(parts)).cast("int")


def count_parts(docs: DataFrame, part_bytes: int = PART_BYTES) -> int:
    return -(-(docs.agg(F.sum(F.octet_length("body"))).first()[0] or 1) // part_bytes)


TEXT_NAMES = ["h", "did", "tie", "loc", "piece"]
TEXT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents with the list of their settled locs (null: none)."""
    return docs.repartition("did", "tie").join(per_document(spans.select("did", "tie", "loc"), "locs", "loc"), ["did", "tie"], "left").select("did", "tie", "body", "named", "locs")


def covered(n: int, locs: list[int] | None, length: int) -> np.ndarray:
    """Mask of the symbols inside any of the windows."""
    if not locs:
        return np.zeros(n, dtype=bool)
    locs = np.asarray(locs, dtype=np.int64)
    lo = locs >> SHIFT
    hi = np.minimum(lo + (locs & LOW) - 1 + length, n)
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, lo, 1)
    np.add.at(depth, hi, -1)
    return np.cumsum(depth[:-1]) > 0
