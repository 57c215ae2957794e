"""Word-level substring dedup with sharded Aho-Corasick automata (operator 10).

``repeats`` confirms which passages recur: it keys every run of L words, drops keys that
occur once, and leads copies of a piece to the first one of their content.  Where a key
has several contents, the windows of their first pieces are matched by two hashes.  So
every document gets to know the pieces of earlier documents that it may repeat.

Documents are dealt into parts, and each part's passages (the texts of those pieces) are
compiled into an automaton of its own over word numbers.  Every document is streamed
through the automaton of its part.  A passage is filed under L // 2 words of it that all
its windows share; around each place where they occur, the windows of the document are
looked up among those of the passages and compared word by word.  Nothing is cut on the
word of a hash, and a window is compared once, however often its words repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core, repeats


def words_of(text: bytes) -> list[bytes]:
    return text.split()  # bytes split at ASCII white space only: \x20 and \x09 to \x0D


def cut_words(length: int):
    def cut(text: bytes, wanted: list[tuple[int, int]]) -> list[bytes]:
        words = words_of(text)
        return [b" ".join(words[lo : lo + n - 1 + length]) for lo, n in wanted]

    return cut


def _window_claims(docs: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    """did, odid, otie, oloc: documents with a window of an open piece, and the first open piece with that window, of a
    document with a smaller doc_id."""
    wanted = repeats.per_document(settled.filter("open"), "wanted", "loc")

    def hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, wanted = core.byte_list(batch.column(2)), batch.column(3).to_pylist()
            dids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in core.chunks(texts):
                words = core.Words(texts[a:b], core.SPACE_WORDS, core.SAME)
                one = core.rolling(words.hash, length)
                two = core.rolling(core.mix64(words.hash + core.U64(1)), length)
                for i in range(a, b):
                    if i and (dids[i], ties[i]) == (dids[i - 1], ties[i - 1]):  # a row that repeats doc_id and text
                        continue
                    locs = np.unique(np.array(wanted[i], dtype=np.int64))
                    n = locs & repeats.LOW
                    at = np.repeat((locs >> repeats.SHIFT) - (np.cumsum(n) - n), n) + np.arange(int(n.sum())) + words.first[i - a]
                    size = len(at)
                    yield pa.RecordBatch.from_arrays([core.as_long(one[at]), core.as_long(two[at]), pa.array(np.full(size, dids[i])), pa.array(np.full(size, ties[i])), pa.array(np.repeat(locs, n))], ["w1", "w2", "did", "tie", "loc"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # window and first piece before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            w1, w2, *piece = (batch.column(i).to_numpy() for i in range(5))
            new = np.ones(len(w1), dtype=bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            if last is not None and last[0] == w1[0] and last[1] == w2[0]:
                new[0] = False
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            owner = [np.where(group >= 0, x[start][np.maximum(group, 0)], 0) if len(start) else np.zeros(len(x), dtype=x.dtype) for x in piece]
            if last is not None:
                for x, v in zip(owner, last[2:], strict=True):
                    x[group < 0] = v
            later = piece[0] > owner[0]
            last = (w1[-1], w2[-1], *(x[-1] for x in owner))
            if later.any():
                claims = np.unique(np.stack([piece[0][later], *(x[later].astype(np.int64) for x in owner)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(claims[0]), pa.array(claims[1]), pa.array(claims[2].astype(np.int32)), pa.array(claims[3])], ["did", "odid", "otie", "oloc"])

    opened = docs.select("did", "tie", "body").repartition("did", "tie").join(wanted, ["did", "tie"]).select("did", "tie", "body", "wanted").sortWithinPartitions("did", "tie")
    windows = opened.mapInArrow(hashing, "w1 long, w2 long, did long, tie int, loc long")
    return windows.repartition("w1").sortWithinPartitions("w1", "w2", "did", "tie", "loc").mapInArrow(stream, "did long, odid long, otie int, oloc long")


class Passages:
    """An automaton of the passages of a part, over numbered words, and their windows: the place and smallest doc_id of each."""

    def __init__(self, owners: list[int], texts: list[bytes], length: int):
        self.length, self.probe = length, max(1, length // 2)
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        seen: dict[tuple[int, ...], int] = {}
        for owner, text in zip(owners, texts, strict=True):
            words = tuple(number(w, len(self.vocabulary) + 1) for w in text.split(b" "))
            seen[words] = min(owner, seen.get(words, owner))
        reach = length - self.probe + 1  # windows in a row that share a probe
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words in seen:
            last = len(words) - length
            for a in range(0, last + 1, reach):
                at = min(a + reach - 1, last)  # in all windows that start from a to here
                self.automaton.add_word(words[at : at + self.probe], 1)
        self.empty = not seen
        if self.empty:
            return
        self.automaton.make_automaton()
        sizes = np.array([len(w) for w in seen])
        self.words = np.fromiter((x for w in seen for x in w), dtype=np.int64, count=int(sizes.sum()))
        n = sizes - length + 1
        self.at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        self.owner = np.repeat(np.array(list(seen.values()), dtype=np.int64), n)
        self.hash = self._hashes(self.words)[self.at]
        by = np.lexsort((self.owner, self.hash))
        by = by[np.concatenate(([True], self.hash[by][1:] != self.hash[by][:-1]))]
        self.hash, self.at, self.owner = self.hash[by], self.at[by], self.owner[by]

    def _hashes(self, words: np.ndarray) -> np.ndarray:
        return core.rolling(core.mix64(words.view(core.U64) + core.U64(core._MULT)), self.length)

    def covered(self, did: int, words: list[bytes]) -> np.ndarray:
        """Mask of the words of a document inside a run of ``length`` words of a passage of a smaller doc_id."""
        mask = np.zeros(len(words), dtype=bool)
        if self.empty or len(words) < self.length:
            return mask
        sequence = tuple(map(self.vocabulary.get, words, (0,) * len(words)))
        end = np.fromiter((e for e, _ in self.automaton.iter(sequence)), dtype=np.int64)
        if not len(end):
            return mask
        # the windows that hold a probe
        depth = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(depth, np.maximum(end + 1 - self.length, 0), 1)
        np.add.at(depth, end - self.probe + 2, -1)
        start = np.flatnonzero(np.cumsum(depth)[: len(words) - self.length + 1] > 0)
        numbers = np.array(sequence, dtype=np.int64)
        value = self._hashes(numbers)[start]
        place = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        some = (self.hash[place] == value) & (self.owner[place] < did)
        start, place = start[some], self.at[place[some]]
        inside = np.arange(self.length)
        for a in range(0, len(start), 8192):
            s, p = start[a : a + 8192], place[a : a + 8192]
            same = (numbers[s[:, None] + inside] == self.words[p[:, None] + inside]).all(axis=1)
            mask |= repeats.covered(len(words), ((s[same] << repeats.SHIFT) | 1).tolist(), self.length)
        return mask


def repeated_phrase_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 25, part_bytes: int = repeats.PART_BYTES) -> DataFrame:
    """Cuts every word covered by a run of ``length`` words that also stands in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the remaining words joined by one space).  Words are runs of anything but
    ASCII white space.  Texts under ``length`` words and null or empty texts lose nothing; texts of any length are streamed
    whole; an empty table gives no rows; other columns are not read.  Documents with the same doc_id (or a null one each)
    remove nothing from each other; see ``repeats`` for the rest.
    """
    anchor = min(anchor, length)
    rows = repeats.prepared(docs, id_col, text_col)
    settled = core.checkpointed(repeats.settle(repeats.pieces(rows, repeats.word_symbols, length, anchor), across_documents=True))
    parts = repeats.count_parts(rows, part_bytes)
    claims = settled.filter("not open").select("did", "odid", "otie", "oloc").unionByName(_window_claims(rows, settled, length))
    claims = core.checkpointed(claims.select(repeats.part_of(F.col("did"), parts).alias("part"), "odid", "otie", "oloc").distinct())
    core.discard(settled)
    owners = claims.select(F.lit(0).cast("long").alias("h"), F.col("odid").alias("did"), F.col("otie").alias("tie"), F.col("oloc").alias("loc"), F.lit(True).alias("open")).distinct()
    texts = repeats.open_texts(rows, owners, cut_words(length)).select(F.col("did").alias("odid"), F.col("tie").alias("otie"), F.col("loc").alias("oloc"), "piece")
    passages = claims.join(texts, ["odid", "otie", "oloc"]).select("part", F.lit(0).alias("kind"), F.col("odid").alias("did"), F.lit(True).alias("named"), "piece")
    whole = rows.select(repeats.part_of(F.col("did"), parts).alias("part"), F.lit(1).alias("kind"), "did", "named", F.col("body").cast("binary").alias("piece"))
    dealt = passages.unionByName(whole).repartition("part").sortWithinPartitions("part", "kind")

    def streaming(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: int | None = None
        owners: list[int] = []
        texts: list[bytes] = []
        automaton: Passages | None = None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for p, kind, did, named, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    part, owners, texts, automaton = p, [], [], None
                if kind == 0:
                    owners.append(did)
                    texts.append(text)
                    continue
                if automaton is None:
                    automaton = Passages(owners, texts, length)
                    owners, texts = [], []
                words = words_of(text)
                mask = automaton.covered(did, words)
                kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone] if mask.any() else words
                for column, value in zip(out, (did if named else None, len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, type=pa.int64()) for x in out[:3]), pa.array(out[3], type=pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return dealt.mapInArrow(streaming, "doc_id long, n_words long, n_removed long, kept string")


def brute_force(texts: dict[int, bytes], length: int = 50) -> dict[int, tuple[int, int, str]]:
    """The same by looking every window up (small inputs)."""
    import re

    first: dict[tuple, int] = {}
    split = {did: re.findall(rb"[^\x20\x09-\x0d]+", t) for did, t in texts.items()}
    for did in sorted(split):
        w = split[did]
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), did)
    out = {}
    for did, w in split.items():
        mask = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < did:
                mask[s : s + length] = True
        kept = b" ".join(x for x, m in zip(w, mask, strict=True) if not m)
        out[did] = (len(w), int(mask.sum()), hashlib.sha256(kept).hexdigest())
    return out
