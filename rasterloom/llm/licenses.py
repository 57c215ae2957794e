"""License scans by an exact set-similarity join (operator 3).

A text block is a run of consecutive words of a document, across line breaks and
comment marks, of a quarter more words than the template it is held against; a
template is the set of words of a licence notice.  A block holds a template when it
contains at least ``threshold`` of its distinct words.

Words of templates are ordered by how often they stand in all documents (counted in a
first pass, rarest first).  With n words, o of which must be shared, a block that
holds the template has one of its first n - o + 1 words (prefix filter); an index
leads from each such word to its templates, and templates without one in a chunk of
documents cost nothing.  Around each such word only the template's own words in reach
are read; a stretch is left out if it has fewer than o of them (length filter) or if
the distinct words from the rarest prefix word on are fewer than o (positional
filter).  What remains is verified by counting the distinct words of every block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core
from .decontaminate import lookup, words_of

#: Fixed by the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices in public use, in words, and their labels.
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-notice", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-notice", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-terms", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-grant", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-notice", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "boost software license version 1 0 permission is hereby granted free of charge to any person or organization"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-endorsement", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced without written permission"),
)


class Notices:
    """Templates over one numbered vocabulary, the index of their prefix words, and phrases as hash sequences."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: dict[str, str], threshold: float):
        self.labels = [label for label, _ in templates]
        words = [[core.hash_word(w.encode()) for w in text.split()] for _, text in templates]
        self.vocabulary = np.array(sorted({w for ws in words for w in ws}), dtype=core.U64)
        self.sets = [np.unique(np.searchsorted(self.vocabulary, np.array(ws, dtype=core.U64))) for ws in words]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.need = np.array([need(n, threshold) for n in self.size.tolist()], dtype=np.int64)
        self.span = [block_words(len(ws)) for ws in words]
        self.phrases = [([core.hash_word(w.encode()) for w in text.split()], label) for text, label in phrases.items()]

    def order(self, counts: dict[int, int]) -> None:
        """Ranks the vocabulary by its counts, rarest first, and files the prefix words of the templates."""
        frequency = np.array([counts.get(i, 0) for i in range(len(self.vocabulary))], dtype=np.int64)
        rank = np.empty(len(frequency), dtype=np.int64)
        rank[np.lexsort((self.vocabulary, frequency))] = np.arange(len(frequency))
        #: place[t][word]: how many of a template's words are rarer; the template's size for words it does not have.
        self.place = np.repeat(self.size[:, None], max(1, len(frequency)), axis=1)
        self.index: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            by_rank = s[np.argsort(rank[s])]
            self.place[t, by_rank] = np.arange(len(s))
            for w in by_rank[: len(s) - self.need[t] + 1].tolist():
                self.index.setdefault(w, []).append(t)
        self.leads = np.zeros(max(1, len(frequency)), dtype=bool)
        self.leads[list(self.index)] = True

    def matches(self, words: core.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, template, most distinct words in a block, first word of that block) of the templates documents hold."""
        place, word = lookup(words.hash, self.vocabulary)
        hit = self.leads[word] if len(word) else np.zeros(0, dtype=bool)
        none = np.zeros(0, dtype=np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        candidates = sorted({t for w in np.unique(word[hit]).tolist() for t in self.index[w]})
        # positions with a gap between documents that no block bridges
        spread = place + words.doc[place] * (max(self.span, default=0) + 1) if len(place) else none
        for t in candidates:
            o, span = int(self.need[t]), self.span[t]
            rarer = self.place[t][word]
            anchors = spread[hit & (rarer <= self.size[t] - o)]
            mine = rarer < self.size[t]
            at, which, rarer = spread[mine], word[mine], rarer[mine]
            near = np.searchsorted(anchors, at - span, "right") < np.searchsorted(anchors, at + span)
            at, which, rarer, doc_at = at[near], which[near], rarer[near], place[mine][near]
            if len(at) < o:
                continue
            # stretches no block bridges: too few words, or too few distinct ones from the rarest on
            cut = np.flatnonzero(np.concatenate(([True], np.diff(at) >= span)))
            stretch = np.cumsum(np.concatenate(([True], np.diff(at) >= span))) - 1
            length = np.diff(np.append(cut, len(at)))
            fits = (length >= o) & (self.size[t] - np.minimum.reduceat(rarer, cut) >= o)
            keep = fits[stretch]
            at, which, doc_at = at[keep], which[keep], doc_at[keep]
            if not len(at):
                continue
            shared = distinct_in_blocks(at, which, span)
            good = np.flatnonzero(shared >= o)
            if not len(good):
                continue
            doc = words.doc[doc_at[good]]
            by = np.lexsort((-at[good], -shared[good], doc))
            first = np.concatenate(([True], doc[by][1:] != doc[by][:-1]))
            best = good[by[first]]
            found.append((words.doc[doc_at[best]], np.full(len(best), t), shared[best], doc_at[best] - words.first[words.doc[doc_at[best]]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none)


def need(size: int, threshold: float) -> int:
    """How many of a template's distinct words a block must have."""
    return max(1, -(-int(round(threshold * 1000)) * size // 1000))


def block_words(n: int) -> int:
    """Words of the blocks that a template of n words is held against."""
    return n + -(-n // 4)


def distinct_in_blocks(at: np.ndarray, which: np.ndarray, span: int) -> np.ndarray:
    """Distinct words in the block that starts at each of the sorted positions.

    Occurrence j counts for the blocks that reach it and start behind the word's occurrence before it.
    """
    n = len(at)
    by = np.lexsort((at, which))
    before = np.full(n, -1, dtype=np.int64)
    same = which[by][1:] == which[by][:-1]
    before[by[1:][same]] = by[:-1][same]
    low = np.maximum(before + 1, np.searchsorted(at, at - span, "right"))
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, low, 1)
    np.add.at(depth, np.arange(n) + 1, -1)
    return np.cumsum(depth[:-1])


def clearest(held: list[tuple[int, int, int]], notices: Notices) -> set[str]:
    """Labels of (template, shared words, first word) of a document, without those whose best block lies by more than half (of
    the shorter) on that of a template it holds a larger share of, or as large a share of more words: of notices that differ
    in a word or two, the one that fits best."""
    out = set()
    for t, shared, start in held:
        better = ((shared * notices.size[u], shared) < (other * notices.size[t], other) and same_place(start, notices.span[t], s, notices.span[u]) for u, other, s in held)
        if not any(better):
            out.add(notices.labels[t])
    return out


def same_place(a: int, n: int, b: int, m: int) -> bool:
    return 2 * (min(a + n, b + m) - max(a, b)) > min(n, m)


RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, all_labels string, score double, blocks array<struct<label: string, first_word: long, share: double>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """Licence phrases and notices of every document.

    Returns id, body, n_words, n_base, first_word, last_word, base_labels, labels, all_labels, score, blocks, one row per row of
    docs.
    blocks: for each template that a block of the document holds, the block with most of its words (the last of equals),
    where it starts and its share.  labels: those of the phrases and of the templates that fit best where blocks
    overlap.  all_labels: those of the phrases and of every template that a block holds.  score: 1 with a phrase, else the largest share of a block, else 0.  Null and empty texts have no words and no
    labels; texts of any length are read whole; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    notices = Notices(templates, phrases, threshold)

    def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(notices.vocabulary), dtype=np.int64)
        for batch in batches:
            texts = core.byte_list(batch.column(0))
            for a, b in core.chunks(texts):
                total += np.bincount(lookup(words_of(texts[a:b]).hash, notices.vocabulary)[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    counted = rows.select("body").mapInArrow(counting, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    notices.order({r[0]: r[1] for r in counted.collect()})  # one row per word of the templates

    def scanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = core.byte_list(batch.column(1))
            n_words, n_base, first, last, base, labels, every, score, blocks = ([] for _ in range(9))
            for a, b in core.chunks(texts):
                words = words_of(texts[a:b])
                docs_here = b - a
                count = np.zeros(docs_here, dtype=np.int64)
                low = np.full(docs_here, np.iinfo(np.int64).max)
                high = np.full(docs_here, -1)
                named: list[set[str]] = [set() for _ in range(docs_here)]
                inside = words.in_doc()
                for sequence, label in notices.phrases:
                    n = len(sequence)
                    at = np.flatnonzero(words.hash[: max(0, len(words.hash) - n + 1)] == core.U64(sequence[0]))
                    for k in range(1, n):
                        at = at[words.hash[at + k] == core.U64(sequence[k])]
                    at = at[words.doc[at] == words.doc[at + n - 1]]
                    d = words.doc[at]
                    count += np.bincount(d, minlength=docs_here)
                    np.minimum.at(low, d, inside[at])
                    np.maximum.at(high, d, inside[at])
                    for x in np.unique(d).tolist():
                        named[x].add(label)
                held: list[list[tuple[int, int, int]]] = [[] for _ in range(docs_here)]
                for d, *match in zip(*(x.tolist() for x in notices.matches(words)), strict=True):
                    held[d].append(tuple(match))
                n_words += words.counts.tolist()
                n_base += count.tolist()
                first += [x if c else None for x, c in zip(low.tolist(), count.tolist(), strict=True)]
                last += [x if c else None for x, c in zip(high.tolist(), count.tolist(), strict=True)]
                base += [",".join(sorted(x)) for x in named]
                labels += [",".join(sorted(x | clearest(h, notices))) for x, h in zip(named, held, strict=True)]
                every += [",".join(sorted(x | {notices.labels[t] for t, _, _ in h})) for x, h in zip(named, held, strict=True)]
                found = [[{"label": notices.labels[t], "first_word": s, "share": shared / int(notices.size[t])} for t, shared, s in h] for h in held]
                blocks += found
                score += [1.0 if c else max((x["share"] for x in f), default=0.0) for f, c in zip(found, count.tolist(), strict=True)]
            long, text = pa.int64(), pa.string()
            kinds = (long, long, long, long, text, text, text, pa.float64(), pa.list_(pa.struct([("label", text), ("first_word", long), ("share", pa.float64())])))
            columns = (n_words, n_base, first, last, base, labels, every, score, blocks)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(x, type=t) for x, t in zip(columns, kinds, strict=True))],
                [*batch.schema.names, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "all_labels", "score", "blocks"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(scanning, f"_id {kind}, body string, {RESULT}").withColumnRenamed("_id", id_col)


def brute_force(text: str | None, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.8) -> tuple:
    """One document, every block word by word."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = pattern.findall(low)
    places, base = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += own
        base |= {label} if own else set()
    held = []
    for label, notice in templates:
        t = set(notice.split())
        span = block_words(len(notice.split()))
        starts = [(len(t & set(words[i : i + span])), i) for i in range(len(words)) if words[i] in t]
        shared, i = max(starts, default=(0, 0))
        if shared >= need(len(t), threshold):
            held.append(((shared / len(t), shared), i, span, label))
    labels = {a[3] for a in held if not any(b[0] > a[0] and same_place(*a[1:3], *b[1:3]) for b in held)}
    blocks = sorted((label, start, share) for (share, _), start, _, label in held)
    score = 1.0 if places else max((x[2] for x in blocks), default=0.0)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, blocks
